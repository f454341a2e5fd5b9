"""Best-fit packing by exact complements.

Only lengths decide, and there are at most ``capacity`` of them, so the plan is made on their counts, with an index of the
sums of one, two and three lengths: for each length, longest first, combinations that exactly fill the gap are consumed
while their lengths are available; a gap that none fills takes what fits it best.  The plan says how many sequences have
each pattern of lengths; pieces, numbered within their length, then take the slots of their length in order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import tokens
from emberline.llm.shared import arrow_rows, written
from emberline.llm.sharding import numbered

#: Ends every document.
END_ID = 0
_SHIFT = 40

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document, cut only where it is longer than the capacity."""
    arrow_rows(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.load(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode(batch["text"].tolist()), strict=True):
                data = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(data), capacity)):
                    part = data[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Sums:
    """Index of the sums of one, two and three available lengths: how many combinations (of distinct kinds) make each sum.

    A length that runs out leaves all three counts at once, so an entry above zero names a combination of lengths that
    are there; whether there are copies enough of each is looked at when it is fetched.
    """

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.left = counts.copy()
        self.singles = (counts > 0).astype(np.int64)
        twice, thrice = np.zeros((2, n), dtype=np.int64)  # the sums of two and of three equal lengths
        twice[::2], thrice[::3] = self.singles[: len(twice[::2])], self.singles[: len(thrice[::3])]

        def sums(*of: np.ndarray) -> np.ndarray:
            spectrum = np.prod([np.fft.rfft(x, 4 * n) for x in of], axis=0)
            return np.rint(np.fft.irfft(spectrum, 4 * n)).astype(np.int64)[:n]

        one = self.singles
        self.pairs = (sums(one, one) + twice) // 2
        self.triples = (sums(one, one, one) + 3 * sums(one, twice) + 2 * thrice) // 6

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        for x in set(lengths):
            if not self.left[x]:
                n = len(self.left) - x
                self.triples[x:] -= self.pairs[:n]
                self.pairs[x:] -= self.singles[:n]
                self.singles[x] = 0

    def has(self, x: int, held: tuple[int, ...]) -> bool:
        """A copy of this length besides those held."""
        return bool(self.left[x] > held.count(x))

    def single(self, total: int, held: tuple[int, ...], most: int) -> tuple[int, ...]:
        return (total,) if total <= most and self.has(total, held) else ()

    def pair(self, total: int, held: tuple[int, ...], most: int) -> tuple[int, ...]:
        """Two lengths of that sum, none over ``most``, the most even first; () if there are none."""
        if total < 2 or not self.pairs[total]:
            return ()
        longer = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        for a in longer[(self.singles[longer] & self.singles[total - longer]) > 0].tolist():
            if self.has(a, held) and self.has(total - a, (*held, a)):
                return a, total - a
        return ()

    def triple(self, total: int, held: tuple[int, ...], most: int) -> tuple[int, ...]:
        """Three lengths of that sum, none over ``most``, the longest first; () if there are none."""
        if total < 3 or not self.triples[total]:
            return ()
        longest = np.arange(min(most, total - 2), (total + 2) // 3 - 1, -1)
        for a in longest[(self.singles[longest] > 0) & (self.pairs[total - longest] > 0)].tolist():
            if self.has(a, held) and (two := self.pair(total - a, (*held, a), a)):
                return (a, *two)
        return ()

    def longest(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...]:
        """The longest available length that the gap holds."""
        fits = np.flatnonzero(self.singles[: gap + 1])[::-1]
        return next(((x,) for x in fits.tolist() if self.has(x, held)), ())


def _made(have: np.ndarray, combined: int) -> list[Pattern]:
    """The plan of counts by length, with combinations of up to so many lengths."""
    capacity, sums, made = len(have) - 1, _Sums(have), []
    for a in range(capacity, 0, -1):
        while sums.left[a]:
            lengths, gap = (a,), capacity - a
            while gap:
                more = next((x for of in (sums.single, sums.pair, sums.triple)[:combined] if (x := of(gap, lengths, a))), ()) or sums.longest(min(gap, a), lengths)
                if not more:
                    break
                lengths, gap = lengths + more, gap - sum(more)
            times = min(int(sums.left[x]) // lengths.count(x) for x in set(lengths))
            made.append((lengths, times))
            sums.take(lengths, times)
    return made


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """(lengths in order, number of sequences) for counts of each length from 1 to the capacity.

    Longest first: the gap beside a length is looked up among the single, pair and triple sums, and a combination that
    fills it exactly is consumed as often as there are copies of all its lengths.  A gap that none fills takes the length
    that fits it best, and what is then left of it is looked up again.  Exact fills can spend short lengths that others
    need; so triples, then pairs, are given up where that saves sequences.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    return min((_made(have, combined) for combined in (3, 2, 1)), key=lambda patterns: sum(n for _, n in patterns))


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), the sequence of that rank, and the offset: one entry for each place of a pattern."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append(((x << _SHIFT) + used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    keys, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
    return keys, sequences, offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A document's ids end with id 0; a null or empty text is that id alone.  Repeated rows and null ids are packed like
    others.  An empty table gives an empty result; other columns are not read.  Brought to the driver: one count for
    each length (``capacity`` at most).
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, capacity), "pack-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not counts:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranked, _ = numbered(cut, ["length", "doc_id", "piece", "ids_crc32"], "pack-ranks")
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    shared = spark.sparkContext.broadcast((before, *_slots(plan(counts, capacity))))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        starts, keys, sequences, offsets = shared.value
        rank = number.to_numpy() - length.map(starts).to_numpy()
        key = (length.to_numpy() << _SHIFT) + rank
        at = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + key - keys[at], "offset": offsets[at]})

    return ranked.withColumn("_at", place("length", "row_number")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
