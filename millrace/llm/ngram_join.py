"""Exact Jaccard self-join on word shingles by PartEnum signatures."""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import U64, mix, shingle_sets, slices
from .components import connected_components

#: Of k, the share by which there are more first-level parts than needed; see Scheme.
LIGHT_SHARE = 16
#: Rows of one pivot that a task compares; a pivot with more partners is dealt to several tasks.
PARTNERS = 2048
#: Open members up to which a group's pairs are tested each; members of larger ones are brought together by prefixes.
GROUP = 8
#: Members of a group that are ranked together, by one task.
CELL = 4096
#: Pivots of a group that the first round tests, and that one round tests at most; further rounds take the rest.
FIRST_PIVOTS, PIVOTS = 32, 1024
#: 64-bit words of the short sketch that travels with a signature.
SHORT = 4
WORDS = [f"s{i}" for i in range(SHORT)]

#: Bits of the filter that goes before a join of texts with ids, 2 MB in all however many ids there are.
FILTER_BITS = 1 << 24
#: Bits that mark frequent shingles, 2 MB in all; at most an eighth of them is set.
FREQUENT_BITS = 1 << 24


class Scheme:
    """PartEnum for Jaccard >= percent / 100.

    Sizes fall into bands whose ends grow by 100 / percent, so that two similar
    sets lie in one band or in two neighbouring ones; a set takes part in its
    own band's scheme and in the next one's. In band b with largest size r, sets
    with Jaccard >= p have a Hamming distance of at most
    k = floor(2 (1 - p) / (1 + p) r); where k is 0 they are equal, and no
    signatures are needed.

    The hash domain is cut into first-level parts and each of these into
    `second` parts; a signature is a choice of all but `miss` second-level parts
    of one first-level part, with all features in them. There are
    k // (miss + 1) + 1 + e first-level parts, so e + 1 of them at least differ in
    no more than `miss` features, and for each of these one signature agrees.

    A set leaves out its signatures of fewer than t features, with the largest t for which
    it has such ones in at most e first-level parts. Of two similar sets take the one with the
    larger t: of the e + 1 agreeing signatures one lies in a part where that set leaves out
    none, so it has t features or more, and the other set, with the same features there and
    no larger t, gives it too. So no pair is lost, and parts that are empty or hold a few
    common shingles bring few strangers together.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self._ends, self._bands = [1], {}

    def band(self, b: int) -> tuple[int, int, int, np.ndarray, np.ndarray] | None:
        """Of band b: e, first- and second-level parts, the latter's first hashes, and which of them a signature has."""
        if b not in self._bands:
            r = self.ends(b + 1)[-1]
            k = 2 * (100 - self.percent) * r // (100 + self.percent)
            miss, second = (k, k + 3) if k <= 2 else (1, 3)
            e = k // LIGHT_SHARE if k > 2 else 0
            first = k // (miss + 1) + 1 + e
            n = first * second
            cuts = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
            chosen = np.array([[i not in out for i in range(second)] for out in combinations(range(second), miss)])
            self._bands[b] = (e, first, second, cuts, chosen) if k else None
        return self._bands[b]

    def ends(self, n: int) -> list[int]:
        """Largest sizes of the first n bands; band b holds the sizes over ends[b - 1] up to ends[b]."""
        while len(self._ends) < n:
            low = self._ends[-1] + 1
            self._ends.append(max(low, low * 100 // self.percent))
        return self._ends[:n]

    def of_size(self, size: int) -> int:
        while self._ends[-1] < size:
            self.ends(2 * len(self._ends))
        return bisect_left(self._ends, size)

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """Of the sorted distinct hashes of a set that is not empty."""
        own = self.of_size(len(features))
        mixed = np.zeros(len(features) + 1, U64)
        np.cumsum(mix(features ^ U64(0xA24BAED4963EE407)), out=mixed[1:])
        out = [np.zeros(0, U64)]
        for b in (own, own + 1):
            if (scheme := self.band(b)) is None:
                continue
            e, first, second, cuts, chosen = scheme
            edges = np.append(np.searchsorted(features, cuts), len(features))
            held = np.diff(edges).reshape(first, second)
            content = mix(mixed[edges[1:]] - mixed[edges[:-1]] + U64(1)).reshape(first, second)
            size = held @ chosen.T.astype(np.int64)
            name = mix(np.arange(first * len(chosen), dtype=U64).reshape(size.shape) + U64(b << 40))
            sig = name.copy()
            for j in range(second):
                turned = mix(content[:, j] + U64(j + 1))
                sig += turned[:, None] * chosen[None, :, j].astype(U64)
            sig = mix(sig)
            out.append(sig[size >= np.partition(size.min(1), e)[e]])
        return np.concatenate(out)


def set_key(features: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(features ^ U64(0x2545F4914F6CDD1D))) + U64(len(features)) * U64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], U64)).view(np.int64)[0])


def parities(features: np.ndarray) -> bytes:
    """For each of a power of two of hash buckets, whether it holds an odd number of features.

    A feature that only one of two sets has changes one bucket, so the sketches
    differ in no more bits than the sets in features. There are over 0.75 buckets a
    feature, so that strangers of any size differ in more than a link allows.
    """
    bits = 1 << max((64 * SHORT).bit_length() - 1, int(0.75 * len(features)).bit_length())
    odd = np.bincount((features & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Those of a column of `parities`, for tests of many pairs at once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
        self.words = np.frombuffer(data, U64, int(ends[-1] - ends[0]) // 8, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, U64)
        self.at, self.size = (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8

    def _rows(self, rows: np.ndarray, size: int, folded: int) -> np.ndarray:
        x = self.words[self.at[rows][:, None] + np.arange(size)]
        return x if size == folded else np.bitwise_xor.reduce(x.reshape(len(rows), size // folded, folded), axis=1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows a[i] and b[i] differ, the longer one folded to the other's length."""
        out = np.zeros(len(a), np.int64)
        sizes = self.size[a] << 32 | self.size[b]
        for both in np.unique(sizes):
            at, p, q = np.flatnonzero(sizes == both), int(both) >> 32, int(both) & 0xFFFFFFFF
            step = max(1, (1 << 18) // max(p, q))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                out[some] = np.bitwise_count(self._rows(a[some], p, min(p, q)) ^ self._rows(b[some], q, min(p, q))).sum(axis=1)
        return out


def short(parity: bytes) -> np.ndarray:
    """A sketch folded to SHORT words; two of them differ in no more bits than the sketches do."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.int64).reshape(-1, SHORT))


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            sketches = Sketches(pa.concat_arrays([batch.column("p_u"), batch.column("p_v")]))
            fit = (100 + percent) * sketches.apart(np.arange(n), np.arange(n, 2 * n)) <= (100 - percent) * both
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(fit))

    return run


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, hashes = batch.column("text"), batch.column("doc_id"), batch.column("h")
            for a, b in slices(texts):
                sets = shingle_sets(texts.slice(a, b - a), width)
                sketches = [parities(s) for s in sets]
                words = np.array([short(p) for p in sketches]).reshape(-1, SHORT)
                yield pa.record_batch(
                    [ids.slice(a, b - a), hashes.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array(sketches, pa.binary()), *(pa.array(w) for w in np.ascontiguousarray(words.T))],
                    names=["doc_id", "h", "n_shingles", "key", "parity", *WORDS],
                )

    return run


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = Scheme(percent), set()
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                sigs, keys = [], []
                for s in shingle_sets(texts.slice(a, b - a), width):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)  # copies within a task give their signatures once
                        sigs.append(scheme.signatures(s))
                        keys.append(np.full(len(sigs[-1]), key, np.int64))
                if sigs:
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    return run


def _shared(cell: int):
    """Of rows sorted by sig and key: those of signatures that several keys have, each key once, with the cell of `cell` members it stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_key = None
        alone = False  # whether the last key is its signature's only one as yet, and so not given out
        run_sig, held = None, 0  # the signature given out last, and how many of its keys

        def given(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            nonlocal run_sig, held
            starts = np.append(0, np.flatnonzero(sig[1:] != sig[:-1]) + 1)
            lens = np.diff(np.append(starts, len(sig)))
            nth = np.arange(len(sig)) - np.repeat(starts, lens)
            if run_sig == sig[0]:
                nth[: lens[0]] += held
            run_sig, held = sig[-1], int(nth[-1]) + 1
            return pa.record_batch([pa.array(sig), pa.array((nth // cell).astype(np.int32)), pa.array(key)], names=["sig", "cell", "key"])

        for batch in batches:
            sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            if len(sig) and last_sig is not None:
                new[0] = sig[0] != last_sig or key[0] != last_key
            sig, key = sig[new], key[new]
            if not len(sig):
                continue
            same = np.zeros(len(sig) + 1, bool)  # whether a row has the signature of the row before
            same[1:-1] = sig[1:] == sig[:-1]
            same[0] = last_sig is not None and sig[0] == last_sig
            out = same[:-1] | same[1:]
            if same[0] and alone:
                yield given(np.array([last_sig]), np.array([last_key]))
            if out.any():
                yield given(sig[out], key[out])
            last_sig, last_key, alone = sig[-1], key[-1], not same[-2]

    return run


def _counted(width: int):
    """How many sets hold a shingle, of those that a task reads, in parts of bounded size."""

    def given(parts: list[np.ndarray]) -> pa.RecordBatch:
        f, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.record_batch([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], names=["f", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                for s in shingle_sets(texts.slice(a, b - a), width):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        parts.append(s)
                        size += len(s)
                if size > 1 << 21:
                    yield given(parts)
                    parts, size = [], 0
        if parts:
            yield given(parts)

    return run


def marked(features: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """1 for each feature whose first bits number a set bit."""
    at = features >> U64(65 - (8 * len(bits)).bit_length())
    return bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1


def prefix(features: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first features of a set, rare ones before frequent ones and then by hash: so many that a similar set has one of its own first features among them.

    Sets with Jaccard >= p share at least p of the larger one. The first of the shared
    features has the others behind it in either set, so it lies among the first
    n - ceil(p n) + 1 of n.
    """
    mark = marked(features, frequent) == 1
    n = len(features)
    return np.concatenate([features[~mark], features[mark]])[: n + percent * -n // 100 + 1]


def _prefixes(width: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, frequent = set(), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                sigs, keys = [], []
                for s in shingle_sets(texts.slice(a, b - a), width):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        sigs.append(mix(prefix(s, frequent, percent) ^ U64(0x9FB21C651E98DF25)))
                        keys.append(np.full(len(sigs[-1]), key, np.int64))
                if sigs:
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    return run


def _across(percent: int):
    """Of rows (sig, salt, member, rank, u, c, n, parity) sorted by the first three: pairs of a pivot (member 0) and a later
    member of other component, where sizes and sketches allow a link. Only the pivots of one signature are kept between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            sig, salt, member, rank, u, c, n = (now.column(i).to_numpy() for i in range(7))
            sketches = Sketches(now.column(7))
            begins = np.ones(len(sig), bool)
            begins[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
            group, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
            pivots = np.bincount(group, member == 0, len(starts)).astype(np.int64)
            at = np.flatnonzero(member == 1)
            found = []
            for j in range(int(pivots.max())):
                at = at[pivots[group[at]] > j]
                to = starts[group[at]] + j
                fit = (rank[at] > rank[to]) & (c[at] != c[to]) & (100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to]))
                v, w = at[fit], to[fit]
                fit = (100 + percent) * sketches.apart(v, w) <= (100 - percent) * (n[v] + n[w])
                found.append(np.stack([u[w[fit]], u[v[fit]]]))
            if found and (pairs := np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)).size:
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])
            held = now.filter(pa.array((group == group[-1]) & (member == 0)))

    return run


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, features = None, None
        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            texts, hits = batch.column("text"), []
            for a, b in slices(texts):
                for i, s in enumerate(shingle_sets(texts.slice(a, b - a), width), a):
                    if vs[i] is None:
                        now, features = us[i], s
                    elif now == us[i]:
                        at = np.minimum(np.searchsorted(features, s), len(features) - 1)
                        both = int((features[at] == s).sum()) if len(features) else 0
                        if 100 * both >= percent * (len(s) + len(features) - both):
                            hits.append(i)
            if hits:
                yield pa.record_batch([pa.array([us[i] for i in hits], pa.int64()), pa.array([vs[i] for i in hits], pa.int64())], names=["u", "v"])

    return run


def _pages(at: Column, ids: DataFrame) -> DataFrame:
    """The places `at` of `ids` as bits, in pages of 32768 of them."""
    return ids.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id and h may be one of `ids`: those whose hash marks a set bit.

    The bits are at most FILTER_BITS / 32768 rows of 4 KB, so they can be broadcast at any size; a join
    with the ids must follow, and shuffles little else than the rows it keeps.
    """
    at = F.pmod(F.xxhash64("doc_id", "h"), F.lit(FILTER_BITS))
    paged = docs.withColumn("at", at).withColumn("page", F.expr("at div 32768")).join(F.broadcast(_pages(at, ids)), "page")
    byte = "cast(conv(hex(substring(bits, cast(at % 32768 div 8 + 1 as int), 1)), 16, 10) as int)"
    return paged.where(F.expr(f"shiftright({byte}, cast(at % 8 as int)) & 1 = 1")).select(*docs.columns)


def _frequent(counts: DataFrame) -> bytes:
    """Bits for the shingles (f, n) that more than GROUP sets hold, or more than the least power of two at which few enough bits are set."""
    by_size = sorted((r.e, r.n) for r in counts.where(F.col("n") > GROUP).groupBy(F.floor(F.log2(F.col("n"))).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, left = GROUP, sum(n for _, n in by_size)
    for e, n in by_size:
        if left <= FREQUENT_BITS // 8:
            break
        left, least = left - n, (2 << e) - 1
    at = F.expr(f"shiftrightunsigned(f, {64 - (FREQUENT_BITS.bit_length() - 1)})")
    out = bytearray(FREQUENT_BITS // 8)
    for r in _pages(at, counts.where(F.col("n") > least)).toLocalIterator():
        out[r.page * 4096 : (r.page + 1) * 4096] = r.bits
    return bytes(out)


def _settle(spark) -> None:
    """Lets Spark remove the shuffle files of jobs that are over."""
    gc.collect()
    spark._jvm.System.gc()


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Groups the rows of `df` whose shingle sets are linked by Jaccard >= percent / 100.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable
    by links. Words are ASCII-lower-cased; a text with fewer than `width` words
    has its whole sequence as its one shingle; a row without words (empty or
    null text) is linked with nothing. Rows with equal sets, repeated rows
    included, are one class from the start and are compared as one; rows of one
    doc_id with different texts are judged each by its own text. doc_id must
    be an integer; a row whose doc_id is null keeps a null component_id and links
    nothing. An empty table gives no rows; other columns are not read.

    Signatures are grouped by a sort on (signature, class). In each group, and in each cell of CELL members of a large one, the class that
    shares most of its signatures comes first, and every other one is compared with it: by
    size and short sketch as the cell is ranked, then by the full sketch, then by the texts. Links
    found so far are closed. Of the groups whose later members are still of several components,
    those of at most GROUP members have their pairs tested each by size and full sketch, where they are read. The
    members of larger ones, mostly strangers that share a frequent passage, are grouped
    anew by their prefixes (rare shingles first, of which any two similar sets share
    one), so that strangers no longer meet; in rounds of growing width pivots are tested until
    no group is left open, a large one dealt to several tasks. So no link
    between components is lost, a group of near copies costs one comparison a
    member, and pairs are rows only if their full sketches allow a link. Shingles and classes are
    told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    store = Scratch(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    words = ", ".join(f"{w} long" for w in WORDS)
    sketch = store.keep(docs.mapInArrow(_sketch(width), f"doc_id long, h long, n_shingles long, key long, parity binary, {words}"), "sketch")
    n_docs = sketch.count()
    known = sketch.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = store.keep(
        known.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.max("n_shingles").alias("n"), F.max("parity").alias("parity"), *(F.max(w).alias(w) for w in WORDS)).withColumnRenamed("key", "u"), "classes", n_docs
    )

    sigs = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_signatures(width, percent), "sig long, key long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = store.keep(sigs.repartition(parts, "sig").sortWithinPartitions("sig", "key").mapInArrow(_shared(CELL), "sig long, cell int, key long").withColumnRenamed("key", "u"), "met")
    n_met = met.count()
    _settle(spark)
    # a cell's first is the class that shares most of its signatures: the text that others are copies of
    sharing = store.keep(met.groupBy("u").agg(F.count(F.lit(1)).alias("d")).join(classes, "u").select("u", (F.col("d") / F.col("n")).alias("share"), "n", *WORDS), "sharing", n_docs)
    order = Window.partitionBy("sig", "cell").orderBy(F.desc("share"), "u")
    rank = (F.row_number().over(order) + F.col("cell").cast("long") * CELL).alias("rank")
    ranked = met.join(sharing, "u").select("sig", "cell", rank, "u", "n", *WORDS, F.first(F.struct("u", "n", *WORDS)).over(order).alias("p"))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col("p")[w])) for w in WORDS), F.lit(0))
    fit = (F.col("u") != F.col("p.u")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("p.n")))
    shared = store.keep(ranked.select("sig", "cell", "rank", "u", F.when(fit, F.col("p.u")).alias("first")), "shared", n_met)
    store.drop(met)

    def near(pairs: DataFrame) -> DataFrame:
        """Those pairs of classes whose full sketches allow a link."""
        one = classes.select("u", F.col("n").alias("n_u"), F.col("parity").alias("p_u"))
        two = classes.select(F.col("u").alias("v"), F.col("n").alias("n_v"), F.col("parity").alias("p_v"))
        return pairs.join(one, "u").join(two, "v").mapInArrow(_near(percent), "u long, v long")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(u, text) of the classes `ids` (u)."""
        at = ids.join(classes.select("u", "rep"), "u").select("u", "rep.doc_id", "rep.h")
        return _among(docs, at).join(at, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("u", "text")

    def verified(pairs: DataFrame, n: int, name: str) -> DataFrame:
        """Those of n pairs whose texts are linked."""
        known_texts = store.keep(texts_of(pairs.select("u").union(pairs.select("v")).distinct()), name + "-texts", 20 * n)
        counts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("salts"))
        salted = pairs.join(counts, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")))
        member = salted.select("u", "salt", "v").join(known_texts.withColumnRenamed("u", "v"), "v").select("u", "salt", "v", "text")
        pivot = counts.join(known_texts, "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "text")
        dealt = member.union(pivot).repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
        out = store.keep(dealt.mapInArrow(_compare(width, percent), "u long, v long"), name, 20 * n)
        store.drop(known_texts)
        return out

    def opened(rest: DataFrame, n: int, name: str) -> DataFrame:
        """Of n rows those of the groups with members of several components, with these and the group's size."""
        label = rest.join(comp.withColumnRenamed("node", "u"), "u", "left").select("sig", "rank", "u", F.coalesce("component", "u").alias("c"))
        open_ = label.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 <> c1").select("sig", "m")
        return store.keep(label.join(open_, "sig"), name, n)

    firsts = shared.where("first IS NOT NULL").select(F.least("u", "first").alias("u"), F.greatest("u", "first").alias("v")).distinct()
    tested = store.keep(near(firsts), "pairs0", n_met)
    n_tested = tested.count()
    links = verified(tested, n_tested, "links0")
    comp = store.keep(connected_components(links, store, n_tested), "comp0", n_tested)
    _settle(spark)

    # the first of a group of one cell has met all others of it
    several = shared.where("cell > 0").select("sig").distinct()
    rest = shared.where("rank > 1").join(several, "sig", "left_anti").union(shared.join(several, "sig", "left_semi"))
    left = opened(rest.select("sig", "rank", "u"), n_met, "open")
    store.drop(shared)
    crowd = store.keep(left.where(F.col("m") > GROUP).select("u").distinct(), "crowd", n_docs)
    rest, n_crowd = left.where(F.col("m") <= GROUP).select("sig", "rank", "u"), crowd.count()
    if n_crowd:
        at = crowd.join(classes, "u").select("rep.doc_id", "rep.h")
        crowded = store.keep(_among(docs.where("doc_id IS NOT NULL"), at).select("text"), "crowded")
        counts = store.keep(crowded.mapInArrow(_counted(width), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP), "counts", 20 * n_crowd)
        frequent = spark.sparkContext.broadcast(_frequent(counts))
        pairs = crowded.mapInArrow(_prefixes(width, percent, frequent), "sig long, key long").withColumnRenamed("key", "u").join(crowd, "u", "left_semi")
        again = pairs.select("sig", F.col("u").alias("key")).repartition(parts, "sig").sortWithinPartitions("sig", "key").mapInArrow(_shared(CELL), "sig long, cell int, key long").withColumnRenamed("key", "u")
        rerank = again.join(sharing, "u").select("sig", rank, "u")
        rest = rest.union(store.keep(rerank, "again", 20 * n_crowd))
        store.drop(crowded, counts)
    store.drop(crowd)

    low, step = 0, max(GROUP, FIRST_PIVOTS)  # ranks up to `low` have met all others of their groups
    n_left = n_met
    while True:
        now = opened(rest, n_left, f"open{low}")
        store.drop(left)
        left, n_left = now, now.count()
        if not n_left:
            break
        wide = left.join(classes.select("u", "n", "parity"), "u").withColumn("salts", F.ceil(F.col("m") / PARTNERS))
        columns = ["rank", "u", "c", "n", "parity"]
        member = wide.select("sig", F.pmod(F.xxhash64("u"), "salts").alias("salt"), F.lit(1).cast("long").alias("member"), *columns)
        pivot = wide.where(F.col("rank") <= low + step).select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).cast("long").alias("member"), *columns)
        dealt = member.union(pivot).repartition(parts, "sig", "salt").sortWithinPartitions("sig", "salt", "member")
        allowed = dealt.mapInArrow(_across(percent), "u long, v long").distinct()
        low += step
        pairs = store.keep(allowed.join(tested, ["u", "v"], "left_anti"), f"pairs{low}", n_left)
        if n := pairs.count():
            found = verified(pairs, n, f"links{low}")
            n_tested += n
            tested = store.keep(tested.union(pairs), f"tested{low}", n_tested)
            if found.take(1):
                links = store.keep(links.union(found), f"all{low}", n_tested)
                comp = store.keep(connected_components(links, store, n_tested), f"comp{low}", n_tested)
        rest = left.where(F.col("rank") > low).select("sig", "rank", "u")
        _settle(spark)
        step = min(8 * step, PIVOTS)

    linked = comp.join(classes.select(F.col("u").alias("node"), "rep.doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    by_key = comp.join(least, "component").select(F.col("node").alias("u"), "least")
    by_key = store.keep(classes.join(by_key, "u", "left").select(F.col("u").alias("key"), F.coalesce("least", "rep.doc_id").alias("least")), "by-key", n_docs)
    store.keep_only(sketch, by_key)
    return sketch.join(by_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
