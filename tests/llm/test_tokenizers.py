import base64
import hashlib
import random

import pytest

from edges import EDGES

from millrace.llm.byte_bpe import Codec, Utf8Machine, encode_table
from millrace.llm.unigram_count import Counter, count_tokens, load_pieces

public = pytest.importorskip("public_tokenizers")
PARTS = ["a", "e", "th", "ing", " ", "  ", "\n", " \n ", "\r\n", " ", " ", "\x1f", "é", "ß", "漢", "😀", "0", "12", "́", "\t", "the", "z" * 9, "!", "==", "\x00", "'s", "▁"]


def texts(seed, n=1500):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(PARTS) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(40)))


@pytest.fixture(scope="module")
def codec():
    return Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def test_encoding_equals_the_library(codec):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks.ids, special_tokens={})
    rng = random.Random(1)
    for t in [*texts(1), "".join(rng.choice("abcdefgh") for _ in range(20000)), "word " * 5000]:
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t)
        assert codec.decode_bytes(ids).decode() == t == "".join(codec.decode_stream(ids))


def test_utf8_machine_equals_replacement():
    rng = random.Random(2)
    for _ in range(2000):
        raw = bytes(rng.choice([rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 65]) for _ in range(rng.randrange(12)))
        m, cut = Utf8Machine(), rng.randrange(len(raw) + 1)
        assert m.feed(raw[:cut]) + m.feed(raw[cut:]) + m.end() == raw.decode("utf-8", "replace")


def test_the_digest_comes_from_the_streaming_decoder(codec, monkeypatch):
    from millrace.llm import byte_bpe

    fed, feed = [], Utf8Machine.feed
    monkeypatch.setattr(Utf8Machine, "feed", lambda self, data: fed.append(data) or feed(self, data))
    for block in (1, 3, 4096):
        monkeypatch.setattr(byte_bpe, "DECODED", block)
        for t in [*texts(9, 200), "", "漢字😀" * 300]:
            fed.clear()
            assert codec.decoded_sha256(codec.encode(t)) == hashlib.sha256(t.encode()).hexdigest()
            assert b"".join(fed) == t.encode()


def test_byte_bpe_table(docs, codec):
    rows = encode_table(docs(EDGES, extra=True), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).collect()
    text = {r[0]: r[1] for r in EDGES}
    assert len(rows) == len(EDGES)
    for r in rows:
        ids = codec.encode(text[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()


def test_ranks_file_is_read_as_it_stands(codec):
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        assert codec.ranks.ids == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_counts_equal_the_library(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = load_pieces(public.path("piece_bpe_32k.model"))
    vocabulary = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -2e9) for i in range(256)], *pieces]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = Counter(pieces)
    for t in texts(3):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    rows = count_tokens(docs(EDGES, extra=True), public.path("piece_bpe_32k.model")).collect()
    text = {r[0]: r[1] for r in EDGES}
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, counter.count(text[i] or "")) for i, *_ in EDGES)


def test_long_pieces_and_small_caches_change_nothing(codec, monkeypatch):
    import tiktoken

    from millrace.llm import byte_bpe

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks.ids, special_tokens={})
    rng = random.Random(4)
    long = ["".join(rng.choice(["th", "e", "in", "tion", "ß", "ñ", "zz"]) for _ in range(6000)) for _ in range(4)] + ["a" * 9000, "é" * 5000]
    few = Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "KEPT_STATES", 50)
    monkeypatch.setattr(byte_bpe.Transducer, "BLOCK", 7)
    for t in [*long, *texts(5, 300)]:
        assert few.encode(t) == own.encode_ordinary(t)


def test_pieces_are_read_abreast_and_equal_ones_once(codec, monkeypatch):
    import tiktoken

    from millrace.llm import byte_bpe

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks.ids, special_tokens={})
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinsß") for _ in range(n)) for n in (1, 2, 5, 9, 60, byte_bpe.ABREAST // 2) for _ in range(20)]
    some = [*texts(7, 200), "", *(" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(100)), ""]
    few = Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    read, read_abreast = [], few.machine.encode_all
    monkeypatch.setattr(few.machine, "encode_all", lambda data, start, length: read.append(len(start)) or read_abreast(data, start, length))
    monkeypatch.setattr(few.machine, "encode", None)
    expected = [own.encode_ordinary(t) for t in some]
    assert [ids.tolist() for ids in few.encode_all(some)] == expected
    assert read == [len({p for t in some for p in few.pattern.findall(t)})]
    for pieces, states in ((200_000, 50), (7, 400_000), (30, 300)):
        monkeypatch.setattr(byte_bpe, "KEPT_PIECES", pieces)
        monkeypatch.setattr(byte_bpe, "KEPT_STATES", states)
        assert [ids.tolist() for ids in few.encode_all(some)] == expected


def test_pieces_of_any_length_in_one_batch(codec):
    import tiktoken

    from millrace.llm import byte_bpe

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks.ids, special_tokens={})
    rng = random.Random(8)
    lengths = [byte_bpe.ABREAST, codec.machine.BLOCK, 2 * codec.machine.BLOCK]
    some = ["".join(rng.choice("ethin") for _ in range(n + more)) + end for n in lengths for more in range(-2, 3) for end in ("", " a")]
    assert [ids.tolist() for ids in codec.encode_all(some)] == [own.encode_ordinary(t) for t in some]
    assert codec.encode("a\ud800") == [i for part in (b"a", "\ud800".encode("utf-8", "surrogatepass")) for i in codec.ranks.merge(part)]


def test_a_token_that_merges_do_not_reach_is_a_whole_piece_only(tmp_path):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"xyz": 258, b" a": 259}
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(k), v) for k, v in ranks.items()))
    codec = Codec(str(path), public.PATTERN)
    own = tiktoken.Encoding("few", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = ["abc", "xyz", "xyzz", "abcd xyz", "xyz abc xyz!", "bc", " a"]
    assert codec.ranks.unmerged == {b"xyz": 258}
    assert [ids.tolist() for ids in codec.encode_all(some)] == [own.encode_ordinary(t) for t in some]


def test_the_last_byte_of_a_piece_makes_no_state():
    few = Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    for c in "abcdefghijklmnopqrstuvwxyz":
        assert few.encode(" qzx" + c) == few.ranks.merge(b" qzx" + c.encode())
    assert len(few.machine.states) <= len(" qzx") + 1
