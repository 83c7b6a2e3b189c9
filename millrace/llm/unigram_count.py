"""Token counts of a unigram vocabulary, without the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 400_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]


class Counter:
    """Counts pieces of the best segmentation.

    The automaton gives all vocabulary matches in the order of their ends, and
    the longest first at one end; the best score and its piece count are carried
    for each place. The tokenizer's rules: a later start replaces an earlier one
    only with a strictly higher score, so ties go to the longest last piece; a
    character that is no piece by itself scores the least score less 10 where no
    match covers it alone, and counts as its UTF-8 bytes (byte fallback).
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.least = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.words: dict[str, int] = {}

    def _count(self, word: str) -> int:
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, single, least = 0, self.single, self.least

        def gap(to: int) -> None:
            """Places up to `to` that no match reached are reached by an unknown character alone."""
            nonlocal at
            while at < to:
                at += 1
                best[at] = best[at - 1] + least
                count[at] = count[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(word):
            end += 1
            if end > at + 1:
                gap(end - 1)
            start = end - length
            score += best[start]
            if end > at:
                at = end
                best[end], count[end] = score, count[start] + 1
                if length > 1 and word[end - 1] not in single and best[end - 1] + least > score:
                    best[end], count[end] = best[end - 1] + least, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            elif score > best[end]:
                best[end], count[end] = score, count[start] + 1
        gap(n)
        return count[n]

    def count(self, text: str) -> int:
        """Of the whole text: spaces become the space mark and begin words; a mark is put first unless one stands there."""
        if not text:
            return 0
        known, total = self.words, 0
        words = text.replace(SPACE, " ").split(" ")
        for word in words if words[0] or len(words) == 1 else words[1:]:
            n = known.get(word)
            if n is None:
                # a line break is in no piece, so parts around it are counted on their own
                head, *lines = word.split("\n")
                n = self._count(SPACE + head) + sum(self._line(x) for x in lines)
                if len(word) <= 64:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def _line(self, part: str) -> int:
        return 1 + (self._count(part) if part else 0)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One for all tasks of a worker, with the words it has met."""
    return Counter(load_pieces(path))


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row of `df`; null and empty texts have none.

    `path` names a vocabulary that every worker can read. Each repeated row gets
    its own row; other columns are not read.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([counter.count(t.as_py() or "") for t in batch.column("text")], pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
