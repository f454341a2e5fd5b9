"""Vector bin packing: examples under limits on tokens, segments and loss-bearing tokens at once, by dot products.

A sequence is filled by always placing, of what still fits under every limit, the example whose needs point most the way
of the room left: the largest dot product of needs and room, both in shares of the limits and weighted by how scarce each
limit is among the waiting examples (Panigrahy et al., Heuristics for vector bin packing).  When nothing fits whole, an
example is cut so that it ends the sequence (if cutting is allowed).  A sequence that can't be filled, because segments
or loss run out or no example is left, ends at a power of two, which needs no padding.

Each task packs its own rows in blocks of bounded size as it encodes them, so no row is shuffled, no group of equal texts
meets in one place, and memory doesn't grow with the input; what a block leaves over goes into sequences of powers of
two, so blocks cost no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import tokens
from emberline.llm.shared import arrow_rows

END_ID = 0
#: Ids of a block, 4 bytes each: what one task holds. An example of more is a block of its own.
BLOCK = 1 << 21
#: sequence_ids that each task has.
_SEQUENCES = 1 << 32


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Piece:
    """Part of an example: where it starts there and how long it is; its sequence and offset, and its loss-bearing tokens."""

    example: int
    start: int
    length: int
    loss: int
    sequence: int = -1
    offset: int = -1


class _Waiting:
    """Pieces that wait, by kind (length, loss): a kind's pieces are alike to the heuristic."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.of: dict[tuple[int, int], list[Piece]] = {}
        self.place: dict[tuple[int, int], int] = {}
        self.kinds = np.zeros((0, 2), dtype=np.int64)
        self.left = np.zeros(0, dtype=np.int64)
        self.total = np.zeros(3)

    def put(self, pieces: Sequence[Piece]) -> None:
        if len(self.left) > 64 and 2 * int((self.left > 0).sum()) < len(self.left):  # kinds that ran out are forgotten
            alive = self.left > 0
            self.kinds, self.left = self.kinds[alive], self.left[alive]
            names = list(map(tuple, self.kinds.tolist()))
            self.of, self.place = {k: self.of[k] for k in names}, {k: i for i, k in enumerate(names)}
        fresh = []
        for p in pieces:
            kind = (p.length, p.loss)
            if kind not in self.of:
                self.of[kind] = []
                self.place[kind] = len(self.kinds) + len(fresh)
                fresh.append(kind)
            self.of[kind].append(p)
        if fresh:
            self.kinds = np.concatenate([self.kinds, np.array(fresh, dtype=np.int64)])
            self.left = np.concatenate([self.left, np.zeros(len(fresh), dtype=np.int64)])
        for p in pieces:
            self.left[self.place[p.length, p.loss]] += 1
            self.total += (p.length, 1, p.loss)

    def take(self, at: int) -> Piece:
        self.left[at] -= 1
        p = self.of[tuple(self.kinds[at].tolist())].pop()
        self.total -= (p.length, 1, p.loss)
        return p

    def best(self, room: np.ndarray) -> int | None:
        """The kind that fits in the room (tokens, segments, loss) and has the largest dot product with it."""
        if room[1] < 1:
            return None
        fits = (self.left > 0) & (self.kinds[:, 0] <= room[0]) & (self.kinds[:, 1] <= room[2])
        some = np.flatnonzero(fits)
        if not len(some):
            return None
        most = np.array([self.limits.tokens, self.limits.segments, max(self.limits.loss, 1)], dtype=np.float64)
        scarce = self.total / most  # sequences that each limit alone would ask for
        weight = scarce / scarce.sum() * (room / most) / most
        return int(some[np.argmax(self.kinds[some, 0] * weight[0] + weight[1] + self.kinds[some, 1] * weight[2])])

    def longest(self) -> int | None:
        some = np.flatnonzero(self.left > 0)
        return int(some[np.argmax(self.kinds[some, 0])]) if len(some) else None


def place(losses: Sequence[np.ndarray], limits: Limits, cut: bool = True) -> list[Piece]:
    """Every token of every example in exactly one piece, with sequences numbered from 0 and offsets in them.

    ``losses`` has an array of flags for each example: which of its tokens bear loss.  Without ``cut`` only examples over
    a limit by themselves are cut.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("a sequence must hold a token, a segment and a token of loss at least")
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in losses]
    done: list[Piece] = []
    waiting, sequence = _Waiting(limits), 0

    def head(p: Piece, tokens_: int, loss: int) -> int:
        """How many of a piece's tokens fit in so much room."""
        own = sums[p.example]
        return min(tokens_, p.length, int(np.searchsorted(own, own[p.start] + loss, side="right")) - 1 - p.start)

    def split(p: Piece, at: int) -> tuple[Piece, Piece]:
        own, middle = sums[p.example], p.start + at
        return Piece(p.example, p.start, at, int(own[middle] - own[p.start])), Piece(p.example, middle, p.length - at, int(own[p.start + p.length] - own[middle]))

    start = []
    for i, x in enumerate(losses):
        rest = Piece(i, 0, len(x), int(sums[i][-1]))
        while rest.length > limits.tokens or rest.loss > limits.loss:
            at = head(rest, limits.tokens, limits.loss)
            whole, rest = split(rest, at)
            if at == limits.tokens or at & (at - 1) == 0:  # a sequence of its own without padding
                whole.sequence, whole.offset = sequence, 0
                sequence += 1
                done.append(whole)
            else:
                start.append(whole)
        if rest.length:
            start.append(rest)
    waiting.put(start)

    while waiting.total[1]:
        inside: list[Piece] = []
        room = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)

        def put(p: Piece) -> None:
            p.sequence, p.offset = sequence, limits.tokens - int(room[0])  # noqa: B023
            room[:] -= (p.length, 1, p.loss)  # noqa: B023
            inside.append(p)  # noqa: B023

        while room[0] and (at := waiting.best(room)) is not None:
            put(waiting.take(at))
        if cut and room[0] and room[1] and (at := waiting.longest()) is not None:
            p = waiting.take(at)
            n = head(p, int(room[0]), int(room[2]))
            if 0 < n < p.length:
                p, rest = split(p, n)
                waiting.put([rest])
                put(p)
            else:
                waiting.put([p])
        used = limits.tokens - int(room[0])
        if cut and room[0] and used & (used - 1):  # what is over a power of two waits on
            most, over = 1 << (used.bit_length() - 1), []
            while inside[-1].offset >= most:
                over.append(inside.pop())
            last = inside[-1]
            if last.offset + last.length > most:
                kept, rest = split(last, most - last.offset)
                kept.sequence, kept.offset = last.sequence, last.offset
                inside[-1] = kept
                over.append(rest)
            for p in over:
                p.sequence = p.offset = -1
            waiting.put(over)
        done += inside
        sequence += 1
    return done


def padding(lengths: Sequence[int], limit: int) -> int:
    """Tokens of padding: sequences are filled up to the limit, but for those whose length is a power of two."""
    return sum(0 if n & (n - 1) == 0 else limit - n for n in lengths)


def pack_examples(examples: DataFrame, vocabulary: str, limits: Limits = Limits(), cut: bool = True, block: int = BLOCK) -> DataFrame:  # noqa: B008
    """doc_id, start, length, loss_tokens, ids_crc32, doc_tokens, sequence_id, offset of each piece of each example.

    ``examples`` has doc_id and parts, an array of (text, loss): an example's ids are its parts', then id 0, which bears
    loss if the last part does.  A null array, part or text is empty; an example without ids is id 0 alone.  Of a part
    that bears loss every token does, but not an example's first, as nothing stands before it.  sequence_ids are the
    task's number and a count, so a repeated task gives them again; repeated rows and null doc_ids are packed like
    others; an empty table gives an empty result; other columns are not read.
    """
    arrow_rows(examples.sparkSession)
    kind = dict(examples.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = tokens.load(vocabulary), TaskContext.get().partitionId() * _SEQUENCES
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        losses: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal first
            pieces = place(losses, limits, cut)
            rows = np.array([(p.example, p.start, p.length, p.loss, zlib.crc32(ids[p.example][p.start : p.start + p.length]), len(ids[p.example]), first + p.sequence, p.offset) for p in pieces], dtype=np.int64).T
            first += 1 + max((p.sequence for p in pieces), default=-1)
            own = pa.concat_arrays(keys).take(pa.array(rows[0]))
            keys.clear()
            ids.clear()
            losses.clear()
            return pa.RecordBatch.from_arrays([own, *map(pa.array, rows[1:])], names=[c.split()[0] for c in schema.split(", ")])

        waiting = 0
        for batch in batches:
            parts = batch.column("parts")
            texts, flags = parts.flatten().field("text").to_pylist(), parts.flatten().field("loss").to_pylist()
            encoded = iter(encoder.encode(texts))
            at = 0
            keys.append(batch.column("doc_id"))
            for n in parts.value_lengths().to_pylist():
                own = [next(encoded) for _ in range(n)]
                bears = flags[at : at + n]
                at += n
                data = np.concatenate([*own, [END_ID]]).astype("<u4")
                loss = np.repeat(np.array([*bears, bears[-1] if bears else True], dtype=bool), [*map(len, own), 1])
                loss[0] = False
                ids.append(data)
                losses.append(loss)
                waiting += len(data)
            if waiting >= block:
                yield packed()
                waiting = 0
        if ids:
            yield packed()

    part = "named_struct('text', coalesce(p.text, ''), 'loss', coalesce(p.loss, false))"
    return examples.selectExpr("doc_id", f"transform(coalesce(parts, array()), p -> {part}) AS parts").mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), block: int = BLOCK) -> DataFrame:  # noqa: B008
    """Documents as examples of one part that bears loss: see ``pack_examples``.  A null text is empty."""
    one = "array(named_struct('text', coalesce(text, ''), 'loss', true)) AS parts"
    return pack_examples(docs.selectExpr("doc_id", one), vocabulary, limits, block=block)


def instructions(turns: DataFrame, answers: str = "assistant") -> DataFrame:
    """doc_id (the conv_id) and parts of each conversation, turns in order: those of one role bear loss.

    A turn without a number comes first; turns of one number are ordered by role and text.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select("doc_id", F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["role"] == answers, F.lit(False)).alias("loss"))).alias("parts"))
