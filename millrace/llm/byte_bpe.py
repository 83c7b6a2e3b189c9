"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker takes at once, and states (and twice so many moves) that it keeps; beyond that it makes them anew, which costs time only.
KEPT_PIECES, KEPT_STATES = 200_000, 400_000
#: Bytes of a piece that is read byte by byte along with others; a longer one is read alone.
ABREAST = 128
#: Tokens that the query's decoder feeds to the machine at once.
DECODED = 4096


class Ranks:
    """A vocabulary of byte strings with ranks, as a trie, and which of its tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = dict(ranks)
        self.bytes = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.unmerged: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for b in word:
                nxt = self.step[at].get(b)
                if nxt is None:
                    nxt = self.step[at][b] = len(self.step)
                    self.step.append({})
                    self.token.append(-1)
                at = nxt
            # a token that the merges don't yield on its own bytes never stands inside an encoding
            self.token[at] = rank if self._last_merge(word, rank) else -1
            if self.token[at] < 0:
                self.unmerged[word] = rank
        self._pairs: dict[tuple[int, int], bool] = {}

    def _parts(self, piece: bytes, down_to: int) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ids = self.ids
        while len(parts) > down_to:
            best = min(range(len(parts) - 1), key=lambda i: (ids.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ids:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the adjacent pair of least rank, the leftmost of equal ones, while there is one."""
        return [self.ids[p] for p in self._parts(piece, 1)]

    def _last_merge(self, word: bytes, rank: int) -> bool:
        """Notes the two tokens that a token is joined from at last; False if the merges don't get there."""
        if len(word) == 1:
            return True
        two = self._parts(word, 2)
        if len(two) == 2:
            self.halves[rank] = self.ids[two[0]], self.ids[two[1]]
        return len(two) == 2

    def follows(self, a: int, b: int) -> bool:
        """Whether b can stand after a: their joined bytes encode to just these two.

        Goes back through the merges that made a and b, the later one first. At each
        time two tokens x and y touch where a and b do; had their join a lower rank
        than the one that x went into, and none higher than that of y (the left one of equal joins
        comes first), it would have been made.
        """
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > KEPT_STATES:
                self._pairs.clear()
            found = self._pairs[a, b] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, x: int, y: int) -> bool:
        ids, raw, halves = self.ids, self.bytes, self.halves
        x_until = y_until = 1 << 60
        while True:
            joined = ids.get(raw[x] + raw[y])
            if joined is not None and joined < x_until and joined <= y_until:
                return False
            left, right = halves.get(x), halves.get(y)
            if left and (x > y or not right):
                x_until, x = x, left[1]
            elif right:
                y_until, y = y, right[0]
            else:
                return True


class Transducer:
    """Reads a piece byte by byte and emits its tokens once no later byte can change them.

    An encoding is the only token sequence in which each neighbouring pair is
    the encoding of its own bytes, so the last token of the encoding of each
    prefix decides the whole. A state holds, for every place from which some
    token may still extend past the bytes read (and for the place reached), the
    trie node of the bytes since and the last token before it. A move gives the
    last token of the prefix read. The sequences that end at a state's places
    begin alike: what they share is emitted, at the end of each block, and only the rest is
    kept. States and their moves are made when first met and kept by number.

    Many pieces are read abreast, a byte of each at a time. Their moves are in a hash
    table of arrays: a state and a byte as key, the next state and the
    token as value. The last byte of a piece needs no state behind it; such a
    move has state 0, which no move leads to, until another piece goes on from there.
    """

    START = ((0, -1),)
    BLOCK = 1024
    TOKEN = (1 << 32) - 1

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.length = [0] * (max(ranks.bytes) + 1)
        for i, b in ranks.bytes.items():
            self.length[i] = len(b)
        self.lengths = np.array(self.length)
        self.depth = [0] * len(ranks.step)
        for node, steps in enumerate(ranks.step):  # a node comes before those below it
            for below in steps.values():
                self.depth[below] = self.depth[node] + 1
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.filled, self.keys, self.values = 0, np.full(1 << 12, -1), np.zeros(1 << 12, np.int64)
        self._intern(self.START)

    def _full(self) -> bool:
        return len(self.states) > KEPT_STATES or len(self.moves) + self.filled > 2 * KEPT_STATES

    def _intern(self, places: tuple) -> int:
        number = self.number.get(places)
        if number is None:
            number = self.number[places] = len(self.states)
            self.states.append(places)
        return number

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free place where it belongs."""
        mask = len(self.keys) - 1
        at = (keys * 0x9E3779B97F4A7C1 >> 24) & mask
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[at[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
            at[todo] = (at[todo] + 1) & mask
        return at

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes in moves of different keys, over those that are there."""
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old = self.keys >= 0
            size = 1 << (3 * (self.filled + len(keys))).bit_length()
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            keys, last = np.unique(keys[::-1], return_index=True)
            values = values[::-1][last]
            self.filled, self.keys, self.values = 0, np.full(size, -1), np.zeros(size, np.int64)
        while len(keys):
            at = self._slots(keys)
            free = self.keys[at] < 0
            self.keys[at] = keys  # of keys that want one free place, one gets it
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            self.filled += int((free & done).sum())
            keys, values = keys[~done], values[~done]

    def _moved(self, keys: np.ndarray, inner: int) -> np.ndarray:
        """The values of keys, of which the first `inner` need the state."""
        at = self._slots(keys)
        value = np.where(self.keys[at] == keys, self.values[at], -1)
        lacks = value < 0
        lacks[:inner] |= value[:inner] <= self.TOKEN
        if lacks.any():
            new, where = np.unique(keys[lacks], return_inverse=True)
            goes_on = np.zeros(len(new), bool)
            goes_on[where[: int(lacks[:inner].sum())]] = True
            made = []
            for key, on in zip(new.tolist(), goes_on.tolist()):
                state, token = self._move(key >> 8, key & 255) if on else (0, self._final(key >> 8, key & 255))
                made.append(state << 32 | token)
            made = np.array(made, np.int64)
            value[lacks] = made[where]
            self._put(new, made)
        return value

    def encode_all(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the pieces that stand in `data`, one piece after the other, and how many each has."""
        if self._full():
            self.clear()
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        reach = np.searchsorted(-length, -np.arange(length[0] + 1)).tolist()  # how many pieces are longer
        base = np.cumsum(length) - length
        last = np.empty(int(length.sum()), np.int64)
        state = np.zeros(len(start), np.int64)
        for at in range(int(length[0])):
            n, inner = reach[at], reach[at + 1]
            value = self._moved(state[:n] << 8 | data[start[:n] + at], inner)
            last[base[:n] + at] = value & self.TOKEN
            state = value[:inner] >> 32
        rounds, todo, end = [], np.flatnonzero(length), length.copy()
        count = np.zeros(len(length), np.int64)
        while len(todo):  # backwards, from the last token of each
            token = last[base[todo] + end[todo] - 1]
            rounds.append((todo, token))
            count[todo] += 1
            end[todo] -= self.lengths[token]
            todo = todo[end[todo] > 0]
        counts = np.empty_like(count)
        counts[order] = count
        ends = np.cumsum(counts)[order]
        ids = np.empty(int(count.sum()), np.int32)
        for back, (which, token) in enumerate(rounds, 1):
            ids[ends[which] - back] = token
        return ids, counts

    def _final(self, state: int, byte: int) -> int:
        """The last token of a piece that ends here."""
        step, tokens = self.ranks.step, self.ranks.token
        for node, last in self.states[state]:
            nxt = step[node].get(byte)
            if nxt is not None and (token := tokens[nxt]) >= 0 and (last < 0 or self.ranks.follows(last, token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        ranks, live, reached = self.ranks, [], -1
        for node, last in self.states[state]:  # earliest first, so the longest token that fits is taken
            nxt = ranks.step[node].get(byte)
            if nxt is None:
                continue
            token = ranks.token[nxt]
            if reached < 0 <= token and (last < 0 or ranks.follows(last, token)):
                reached = token
            if ranks.step[nxt]:
                live.append((nxt, last))
        if reached < 0:
            raise ValueError("the vocabulary lacks a byte")
        live.append((0, reached))
        return self._intern(tuple(live)), reached

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens up to `end`, given the last token before each place."""
        out = []
        while end:
            out.append(last[end - 1])
            end -= self.length[out[-1]]
        out.reverse()
        return out

    def _sure(self, last: list[int], state: int) -> int:
        """The place up to which the sequences to all places of a state agree."""
        ends = {len(last) - self.depth[node] for node, _ in self.states[state]}
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - self.length[last[end - 1]])
        return ends.pop()

    def encode(self, piece: bytes) -> list[int]:
        state, last, out = 0, [], []
        for at in range(0, len(piece), self.BLOCK):
            if self._full():
                places = self.states[state]
                self.clear()
                state = self._intern(places)
            moves = self.moves
            for byte in piece[at : at + self.BLOCK]:
                key = state << 8 | byte
                if key not in moves:
                    moves[key] = self._move(state, byte)
                state, token = moves[key]
                last.append(token)
            if at + self.BLOCK < len(piece):
                sure = self._sure(last, state)
                out += self._back(last, sure)
                del last[:sure]
        return out + self._back(last, len(last))


class Utf8Machine:
    """Incremental UTF-8: text of the bytes fed so far, as far as it is complete.

    The state is the bytes still due for a code point, the range its next byte
    must lie in and those read. Ill-formed bytes become U+FFFD, one for each
    maximal part that begins a code point.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        """Text of the bytes, as far as it is complete."""
        begun = ""
        if self.due:
            head, data = data[: self.due], data[self.due :]
            begun = self._step(head)
        return begun + (self._step(data) if self.due else self._run(data))

    def _run(self, data: bytes) -> str:
        """From the state without due bytes: a well-formed stretch is taken at once, by the same rules."""
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # the last bytes may begin a code point
            b = data[cut - back]
            if b >= 0xC0:
                cut -= back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
            if b >= 0xC0 or b < 0x80:
                break
        try:
            return data[:cut].decode("utf-8") + self._step(data[cut:])
        except UnicodeDecodeError:
            return self._step(data)

    def _step(self, data: bytes) -> str:
        out, i = [], 0
        while i < len(data):
            b = data[i]
            if self.due:
                if self.low <= b <= self.high:
                    self.held += data[i : i + 1]
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    i += 1
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                else:
                    out.append("�")
                    self.due, self.low, self.high = 0, 0x80, 0xBF
                continue
            i += 1
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held = bytes([b])
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.due else ""
        self.__init__()
        return left


class Codec:
    """Encodes texts by a pattern and ranks, and decodes ids to bytes or, streaming, to text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = Ranks({base64.b64decode(a): int(b) for a, b in pairs})
        self.pattern = regex.compile(pattern)
        self.machine = Transducer(self.ranks)
        self.unmerged = pa.array(list(self.ranks.unmerged), pa.binary())
        every = range(max(self.ranks.bytes) + 1)
        self.decimals = np.array([b"%d," % i for i in every])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has. Equal pieces are encoded once."""
        try:
            found = pa.array(pieces, pa.string()).cast(pa.binary())
        except UnicodeEncodeError:
            found = pa.array([p.encode("utf-8", "surrogatepass") for p in pieces], pa.binary())
        found = found.dictionary_encode()
        code, words = found.indices.to_numpy(), found.dictionary
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        start, length = offsets[:-1], np.diff(offsets)
        alone = length > ABREAST
        if len(self.unmerged):
            alone |= pc.is_in(words, value_set=self.unmerged).to_numpy(zero_copy_only=False)
        ids, at, counts = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n = 0

        def take(which: np.ndarray, new: np.ndarray, count: np.ndarray) -> None:
            nonlocal n
            at[which], counts[which] = n + np.cumsum(count) - count, count
            ids.append(new)
            n += len(new)

        for i in np.flatnonzero(alone):
            raw = words[int(i)].as_py()
            whole = self.ranks.ids.get(raw)
            new = np.array([whole] if whole is not None else self.machine.encode(raw), np.int32)
            take(np.array([i]), new, np.array([len(new)]))
        rest = np.flatnonzero(~alone)
        lot = np.cumsum(length[rest]) // max(1, KEPT_STATES // 4)
        for which in np.split(rest, np.flatnonzero(np.diff(lot)) + 1):
            if len(which):
                take(which, *self.machine.encode_all(data, start[which], length[which]))
        count = counts[code]
        first = np.repeat(at[code] - (np.cumsum(count) - count), count)
        return np.concatenate([*ids, np.empty(0, np.int32)])[first + np.arange(len(first))], count

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        pieces, ends, size = [], [], 0
        for text in texts:
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
            size += len(text)
            if len(pieces) >= KEPT_PIECES or size >= 16 * KEPT_PIECES:
                yield from self._cut(pieces, ends)
                pieces, ends, size = [], [], 0
        yield from self._cut(pieces, ends)

    def _cut(self, pieces: list[str], ends: list[int]) -> Iterator[np.ndarray]:
        parts = [self._pieces(pieces[i : i + KEPT_PIECES]) for i in range(0, len(pieces), KEPT_PIECES)]
        ids = np.concatenate([np.empty(0, np.int32), *[i for i, _ in parts]])
        until = np.cumsum(np.concatenate([np.zeros(1, np.int64), *[c for _, c in parts]]))
        begin = 0
        for end in until[ends].tolist():
            yield ids[begin:end]
            begin = end

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def ids_sha256(self, ids: np.ndarray) -> str:
        """Of the ids' decimals, joined by commas."""
        return hashlib.sha256(self.decimals[ids].tobytes().translate(None, b"\0")[:-1]).hexdigest()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids))

    def decode_stream(self, ids: list[int], block: int = 1) -> Iterator[str]:
        """The text of each `block` of tokens as far as its code points are complete; at the end what is left."""
        machine = Utf8Machine()
        for i in range(0, len(ids), block):
            yield machine.feed(self.decode_bytes(ids[i : i + block]))
        yield machine.end()

    def decoded_sha256(self, ids: list[int]) -> str:
        """Of the decoded text's UTF-8, by the streaming decoder."""
        sha = hashlib.sha256()
        for text in self.decode_stream(ids, DECODED):
            sha.update(text.encode("utf-8"))
        return sha.hexdigest()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a worker, with the states it has met.

    These hold no reference cycles, so the search for such among all of them,
    which takes as long as the work itself, is put off.
    """
    gc.set_threshold(100_000, 50, 1_000_000)
    return Codec(path, pattern)


def encode_table(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ids) for every row of `df`.

    `path` names a rank file that every worker can read. A null text counts as
    empty: no tokens, and the digests of nothing. Each repeated row gets its own
    row. Workers keep the transducer's states up to a fixed number.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha, every = [], [], [], []
            for ids in codec.encode_all(t.as_py() or "" for t in batch.column("text")):
                counts.append(len(ids))
                ids_sha.append(codec.ids_sha256(ids))
                ids = ids.tolist()
                text_sha.append(codec.decoded_sha256(ids))
                if with_ids:
                    every.append(ids)
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(every, pa.list_(pa.int32())))
                out.append("ids")
            yield pa.record_batch(cols, names=out)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
