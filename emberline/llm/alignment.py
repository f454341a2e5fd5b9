"""Which tokens of two tokenizers cover the same bytes, and how many documents link each pair, by a dictionary of groups.

Where tokens of both end at the same byte, a text is cut into groups of A-ids and B-ids.  The same few groups occur again
and again, so distinct groups are interned: each document holds its distinct groups with their multiplicities, links are
expanded once for each distinct group, weighed by the number of documents that hold it, and what that gives is joined back
to the documents by the group's key.  A pair of ids that a document links in several of its groups would count once for
each; the document itself, which has all of its groups at hand, says how often too many, so counts are exact.

Groups that many documents hold are few (n holdings in all leave at most n / m groups with m or more), so they are
broadcast, and only rare groups are shuffled with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.bpe import byte_symbols
from emberline.llm.shared import arrow_rows, discard, written
from emberline.llm.tokens import PieceIds, TextIds

#: Longer group keys are replaced by a digest (17 bytes, which no key of whole ids has).
KEY_BYTES = 32
#: Groups that are broadcast, about: those that the most documents hold.
HOT_GROUPS = 100_000
#: Pairs of a group up to which they are expanded with those of others.
_TOGETHER = 4096
_HALF = 32


class TwoTokenizers:
    """Ids of whole texts by both tokenizers, and what the ids stand for."""

    def __init__(self, byte_bpe: str, piece_model: str):
        self.a = TextIds(byte_bpe, plain_specials=True)
        value = {c: b for b, c in enumerate(byte_symbols())}
        vocabulary = self.a.library.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            a_bytes[i] = bytes([value[c] for c in s])
        self.b = PieceIds(piece_model)
        library = self.b.library
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        b_bytes = [bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.wide = np.dtype("<u4" if max(len(a_bytes), len(pieces)) >= 0xFFFF else "<u2")
        self.a_bytes, self.b_bytes = _Strings(a_bytes), _Strings(b_bytes)
        # How an id is written if others of its tokenizer follow in its group, and if not.
        shown = [[b"%d," % i for i in range(n)] + [b"%d%c" % (i, end) for i in range(n)] for n, end in ((len(a_bytes), b"|"), (len(pieces), b";"))]
        self.shown = _Strings(shown[0] + shown[1])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's ids of a space and the text, and B's of the text; None for an empty text and where either spells otherwise."""
        some = [t for t in texts if t]
        both = iter(zip(some, self.a.encode([" " + t for t in some]), self.b.encode(some), strict=True))
        return [self._same(*next(both)) if t else None for t in texts]

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        data = b" " + text.encode()
        a, b = a.astype(np.int64), b.astype(np.int64)
        return (a, b) if self.b_bytes.joined(b) == data and self.a_bytes.joined(a) == data else None


class _Strings:
    """Strings of bytes by number, joined without a step for each."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array(list(map(len, strings)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)].tobytes()


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For things of these sizes, one after the other: of each part, whose it is and its place there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, equal for equal ones, in the order in which they come; and where each comes first."""
    number, known = pd.factorize(values)
    first = np.empty(len(known), dtype=np.int64)
    first[number[::-1]] = np.arange(len(values))[::-1]
    return number, first


@dataclass
class Grouped:
    """The groups of some texts, one after the other: group g has A-ids a[at_a[g] :][: n_a[g]], and so on; doc is its text.

    number: which of the distinct groups it is; distinct: where each of these stands first.
    """

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    distinct: np.ndarray

    @classmethod
    def of(cls, two: TwoTokenizers, ids: list[tuple[np.ndarray, np.ndarray] | None]) -> Grouped:
        none = np.zeros(0, dtype=np.int64)
        a, b = (np.concatenate([none, *[x[k] for x in ids if x]]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(two.a_bytes.sizes[a]), np.cumsum(two.b_bytes.sizes[b])  # texts have as many bytes by both, so they end together
        after = np.searchsorted(ends_b, ends_a)
        meet = np.flatnonzero(ends_b[np.minimum(after, max(len(b) - 1, 0))] == ends_a) if len(b) else none
        stop_a, stop_b = meet + 1, after[meet] + 1
        at_a, at_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) if len(x) else none for x in (stop_a, stop_b))
        doc = np.repeat(np.arange(len(ids)), [len(x[0]) if x else 0 for x in ids])[at_a]
        number, distinct = cls._interned(two, a, b, at_a, at_b, stop_a - at_a, stop_b - at_b)
        return cls(a, b, at_a, at_b, stop_a - at_a, stop_b - at_b, doc, number, distinct)

    @staticmethod
    def _interned(two: TwoTokenizers, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each group and where each distinct one stands first, by hashes that are checked on the ids."""
        if not len(at_a):
            return at_a, at_a
        hashes, places = np.zeros(len(at_a), dtype=np.uint64), []
        for side, ids, at, n in ((1, a, at_a, n_a), (2, b, at_b, n_b)):
            owner, place = _spans(n)
            places.append((ids, at, owner, place))
            hashes += np.add.reduceat(_mixed(_mixed(ids.astype(np.uint64) * np.uint64(2) + np.uint64(side)) + place.astype(np.uint64)), at)
        number, distinct = _numbered(hashes)
        first = distinct[number]
        same = np.array_equal(n_a, n_a[first]) and np.array_equal(n_b, n_b[first]) and all(np.array_equal(ids, ids[at[first][owner] + place]) for ids, at, owner, place in places)
        if not same:  # two groups under one hash
            known: dict[tuple[bytes, bytes], int] = {}
            found = [known.setdefault((a[i : i + n].tobytes(), b[j : j + m].tobytes()), len(known)) for i, n, j, m in zip(at_a, n_a, at_b, n_b, strict=True)]
            number, distinct = _numbered(np.array(found))
        return number, distinct

    def contents(self, wide: np.dtype) -> pa.Array:
        """Each distinct group as bytes: A-ids, the largest number, B-ids."""
        d = self.distinct
        n_a, n_b = self.n_a[d], self.n_b[d]
        ends = np.cumsum(n_a + n_b + 1)
        starts = ends - (n_a + n_b + 1)
        flat = np.full(int(ends[-1]) if len(ends) else 0, np.iinfo(wide).max, dtype=wide)
        for ids, at, n, to in ((self.a, self.at_a[d], n_a, starts), (self.b, self.at_b[d], n_b, starts + n_a + 1)):
            owner, place = _spans(n)
            flat[to[owner] + place] = ids[at[owner] + place]
        offsets = np.concatenate([[0], ends]).astype(np.int64) * wide.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(d), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def shown(self, two: TwoTokenizers, docs: int) -> list[bytes]:
        """Each text's groups as they are written for the digest; empty without groups."""
        v_a, v_b = len(two.a_bytes.sizes), len(two.b_bytes.sizes)
        start = self.at_a + self.at_b
        codes = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        for ids, n, to, base, size in ((self.a, self.n_a, start, 0, v_a), (self.b, self.n_b, start + self.n_a, 2 * v_a, v_b)):
            owner, place = _spans(n)
            codes[to[owner] + place] = base + ids + np.where(place == n[owner] - 1, size, 0)
        cuts = np.concatenate([start, [len(codes)]])[np.searchsorted(self.doc, np.arange(docs + 1))]
        cuts = np.concatenate([[0], np.cumsum(two.shown.sizes[codes])])[cuts].tolist()
        every = two.shown.joined(codes)
        return [every[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:], strict=False)]

    def twice(self, held_doc: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, pair, extra: pairs that several of a text's distinct groups link, and in how many more than one.

        held_doc and held: the distinct groups of each text, by number.
        """
        pairs, sizes = self._pairs()
        many = np.bincount(held_doc[sizes[held] > 1], minlength=int(held_doc.max(initial=-1)) + 1) > 0  # elsewhere distinct groups are distinct pairs
        some = many[held_doc] if len(held_doc) else np.zeros(0, dtype=bool)
        held_doc, held = held_doc[some], held[some]
        owner, place = _spans(sizes[held])
        codes = pairs[(np.cumsum(sizes) - sizes)[held][owner] + place]
        docs = held_doc[owner]
        order = np.lexsort((codes, docs))
        codes, docs = codes[order], docs[order]
        fresh = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])])) if len(codes) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.concatenate([fresh, [len(codes)]]))
        return docs[fresh][n > 1], codes[fresh][n > 1], n[n > 1] - 1

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of all distinct groups, one after the other, and how many each has."""
        d = self.distinct
        links = self.n_a[d] * self.n_b[d]
        small = np.flatnonzero(links <= _TOGETHER)
        owner, place = _spans(links[small])
        g = d[small][owner]
        code = (self.a[self.at_a[g] + place // self.n_b[g]] << _HALF) | self.b[self.at_b[g] + place % self.n_b[g]]
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, dtype=bool)
        owner, code = owner[fresh], code[fresh]
        sizes = np.zeros(len(d), dtype=np.int64)
        sizes[small] = np.bincount(owner, minlength=len(small))
        if len(small) == len(d):
            return code, sizes
        parts = dict(zip(small.tolist(), np.split(code, np.cumsum(sizes[small])[:-1]), strict=True))
        for k in np.flatnonzero(links > _TOGETHER).tolist():
            x, y = np.unique(self.a[self.at_a[d[k]] :][: self.n_a[d[k]]]), np.unique(self.b[self.at_b[d[k]] :][: self.n_b[d[k]]])
            parts[k] = np.add.outer(x << _HALF, y).ravel()
            sizes[k] = len(parts[k])
        return np.concatenate([parts[k] for k in range(len(d))]), sizes


def expanded(content: bytes, wide: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct A-ids and B-ids that a group links and how often it links each two: (a, b, times)."""
    ids = np.frombuffer(content, dtype=wide)
    at = int(np.flatnonzero(ids == np.iinfo(wide).max)[0])
    a, of_a = np.unique(ids[:at], return_counts=True)
    b, of_b = np.unique(ids[at + 1 :], return_counts=True)
    return np.repeat(a, len(b)).astype(np.int64), np.tile(b, len(a)).astype(np.int64), np.outer(of_a, of_b).ravel()


@lru_cache(maxsize=1)
def load(byte_bpe: str, piece_model: str) -> TwoTokenizers:
    """One for each pair of vocabularies and Python worker."""
    return TwoTokenizers(byte_bpe, piece_model)


_ALIGNED = "node long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held array<struct<key: binary, times: long>>, long_keys array<binary>, long_groups array<binary>, twice array<struct<pair: long, extra: long>>"


def aligned(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """A row for each document: a number of its own (node), doc_id, counts, the digest, its distinct groups and repeated pairs.

    held: each distinct group's key with how often the document has it; long_keys and long_groups: the contents behind
    keys that are digests; twice: pairs that several of its distinct groups link, with how many more than one.
    """
    arrow_rows(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, node = load(byte_bpe, piece_model), TaskContext.get().partitionId() << 33
        for batch in batches:
            n = len(batch)
            groups = Grouped.of(two, two.encode(batch.column("text").to_pylist()))
            each = np.concatenate([groups.doc, np.arange(n)])  # every text at least once, with nothing
            sums = [np.bincount(each, weights=np.concatenate([x, np.zeros(n)]), minlength=n).astype(np.int64) for x in (groups.n_a, groups.n_b, np.ones(len(groups.doc)), groups.n_a * groups.n_b)]
            holdings, times = np.unique(groups.doc * max(len(groups.distinct), 1) + groups.number, return_counts=True)
            held_doc, held = np.divmod(holdings, max(len(groups.distinct), 1))
            contents = groups.contents(two.wide)
            far = pc.greater(pc.binary_length(contents), KEY_BYTES)
            is_far = far.to_numpy(zero_copy_only=False)
            digests = [None] * len(contents)
            for k in np.flatnonzero(is_far).tolist():
                digests[k] = b"#" + blake2b(contents[k].as_py(), digest_size=16).digest()
            keys = pc.if_else(far, pa.array(digests, pa.large_binary()), contents).cast(pa.binary())
            far_doc, far_held = held_doc[is_far[held]], held[is_far[held]]
            twice_doc, pair, extra = groups.twice(held_doc, held)
            lists = lambda owner, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)
            columns = [
                pa.array(node + np.arange(n)), *map(pa.array, sums), pa.array([sha256(x).hexdigest() if x else "" for x in groups.shown(two, n)]),
                lists(held_doc, pa.StructArray.from_arrays([keys.take(pa.array(held)), pa.array(times.astype(np.int64))], ["key", "times"])),
                lists(far_doc, keys.take(pa.array(far_held))),
                lists(far_doc, contents.take(pa.array(far_held)).cast(pa.binary())),
                lists(twice_doc, pa.StructArray.from_arrays([pa.array(pair), pa.array(extra)], ["pair", "extra"])),
            ]
            node += n
            names = ["node", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "long_keys", "long_groups", "twice"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {_ALIGNED}")


def _pairs(groups: DataFrame, wide: np.dtype) -> DataFrame:
    """key, docs, pair, times for each two ids that a distinct group (key, docs, content) links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = batch.column("key"), batch.column("docs")
            for k, content in enumerate(batch.column("content").to_pylist()):
                a, b, times = expanded(content, wide)
                for at in range(0, len(a), 65_536):  # a long group has many pairs
                    pair = ((a[at : at + 65_536] << _HALF) | b[at : at + 65_536]).astype(np.int64)
                    own = pa.array(np.full(len(pair), k))
                    yield pa.RecordBatch.from_arrays([keys.take(own), docs.take(own), pa.array(pair), pa.array(times[at : at + 65_536].astype(np.int64))], names=["key", "docs", "pair", "times"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if sum(map(len, held)) >= 65_536 or len(held) >= 4096:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    return groups.select("key", "docs", "content").mapInArrow(together, "key binary, docs long, pair long, times long")


def linked(rows: DataFrame, wide: np.dtype) -> tuple[DataFrame, DataFrame]:
    """(key, docs, n_best, count_sum) of each distinct group of ``aligned`` rows, and (pair, n), the documents of each linked pair.

    n_best and count_sum are those of one occurrence of the group.  pair is the A-id shifted by 32 bits, with the B-id.
    """
    short = F.length("key") != 17
    dictionary = written(rows.select(F.explode("held.key").alias("key")).groupBy("key").agg(F.count("*").alias("docs")), "align-dictionary")
    contents = rows.select(F.explode(F.arrays_zip("long_keys", "long_groups")).alias("g")).groupBy(F.col("g.long_keys").alias("key")).agg(F.min("g.long_groups").alias("content"))
    groups = dictionary.filter(short).withColumn("content", F.col("key")).unionByName(dictionary.filter(~short).join(contents, "key"))
    pairs = written(_pairs(groups, wide), "align-pairs")
    twice = rows.select(F.explode("twice").alias("t")).select("t.pair", (-F.col("t.extra")).alias("n"))
    counts = written(pairs.select("pair", F.col("docs").alias("n")).unionByName(twice).groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    a = F.shiftright("pair", _HALF)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("best"))  # a row for each id of A's vocabulary at most
    met = pairs.join(counts, "pair").withColumn("a", a).join(F.broadcast(best), "a")
    values = met.groupBy("key").agg(F.max("docs").alias("docs"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    values = written(values, "align-values")
    discard(dictionary, pairs)
    return values, counts


def align(docs: DataFrame, byte_bpe: str, piece_model: str, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A encodes a space and the text, B the text (and puts the space itself).  Texts that are null or empty, or that either
    tokenizer spells otherwise, have no tokens: zeros and an empty digest.  Repeated rows count as documents of their
    own, null doc_ids too.  An empty table gives an empty result; other columns are not read.  To the driver comes one
    number, the sum of the documents' distinct groups.
    """
    rows = written(aligned(docs, byte_bpe, piece_model), "aligned")
    values, counts = linked(rows, load(byte_bpe, piece_model).wide)
    discard(counts)
    total = values.agg(F.sum("docs")).first()[0] or 0
    least = max(1, -(-total // hot_groups))  # at most ``hot_groups`` groups are held by so many documents
    holdings = rows.select("node", F.explode("held").alias("h")).select("node", "h.key", "h.times")
    weighed = [(F.col(c) * F.col("times")).alias(c) for c in ("n_best", "count_sum")]
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    hot = F.broadcast(values.filter(F.col("docs") >= least).drop("docs"))
    found = holdings.join(hot, "key").select("node", *weighed)
    if least > 1:
        rare = holdings.join(hot.select("key"), "key", "left_anti").join(values.filter(F.col("docs") < least).drop("docs"), "key").select("node", *weighed)
        found = found.groupBy("node").agg(*sums).unionByName(rare.groupBy("node").agg(*sums))
    totals = found.groupBy("node").agg(*sums)
    own = rows.select("node", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.join(totals, "node", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
