"""SimHash near-duplicates at a similarity that fingerprints alone can't see: linked by the Jaccard similarity of word shingles.

Texts whose fingerprints differ in at most two bits are candidates (operator 10's multi-index hashing).  At a similarity
of 0.8 about ten of 64 bits differ, further than any Hamming ball that can be enumerated, so the rest is found by prefix
filtering: two sets of similarity t or more share one of the first |x| - ceil(t |x|) + 1 elements of each, in any one order
of all elements.  So texts meet in those elements only, and an element that both hold is possible only where enough
elements follow it on both sides.  Common elements (by a sample, which decides the order and so the work, never the
result) stand last.  In each element's bucket texts are first compared with the most typical of them, that with the fewest
rarer elements, which joins most of a large group; then each text is compared with all that are not yet in its group.

Before texts are fetched, the parities of their elements in 256 bins are compared: each element that only one of two sets
has flips one bit, so the bits that differ are at most as many as those elements.  What is left is verified on the
shingles of the whole texts (64-bit hashes of them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import arrow_rows, discard, few, written
from emberline.llm.simhash import components, links

SHINGLE, LEAST = 5, 0.8
#: One text in so many is sampled for common elements; those found this often stand last, of the most common so many.
SAMPLED, OFTEN, MOST = 16, 4, 200_000
_SEED, _WORDS, _SLACK = 42, 500_000, 1e-9
_MARKS = ["fp", "s0", "s1", "s2", "s3"]
_SIZE, _POS = "CAST(shiftright(sp, 32) AS int) AS size", "CAST(sp & 4294967295L AS int) AS pos"
_ODD = np.random.default_rng(_SEED).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """The hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, _SEED)
        return h


_words = _Words()


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, and so is one without words."""
    words = text.lower().split()  # of bytes: A-Z, and white space as the contract has it
    n = len(words) - shingle + 1
    if n <= 0:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED + 1)], dtype=np.uint64)
    one = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        h += one[k : k + n] * _ODD[k]
    h ^= h >> np.uint64(31)
    h *= _ODD[-1]
    return np.unique(h ^ (h >> np.uint64(29)))


def _shared_least(n: int, least: float) -> int:
    """How many elements a set of n shares with any of this similarity, at least."""
    return max(1, math.ceil(least * n - _SLACK))


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common elements, sorted, and how often the sample has each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"token": np.concatenate([shingles(t, shingle) for t in batch["data"]]).view(np.int64)})

    sample = rows.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)
    found = sample.mapInPandas(run, "token long").groupBy("token").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(MOST).toPandas().sort_values("token")
    return found["token"].to_numpy(dtype=np.int64), found["count"].to_numpy(dtype=np.int64)


def _entries(rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """token, node, sp: the elements in which a text may meet others, its size and where they stand in its order (_SIZE, _POS).

    The entry at place 0 also has the text's fingerprint (fp) and parities (s0 to s3).
    """
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, often = common.value
        for batch in batches:
            sizes, firsts, marks = [], [], []
            for text in batch["data"]:
                hashes = shingles(text, shingle)
                marks.append(np.concatenate([[majority(hashes)], parities(hashes)]))
                own = hashes.view(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.lexsort((own, np.where(known[at] == own, often[at], 0)))]
                else:
                    own = np.sort(own)
                sizes.append(len(own))
                firsts.append(own[: len(own) - _shared_least(len(own), least) + 1])
            n = np.array([len(f) for f in firsts])
            pos = np.concatenate([np.arange(k, dtype=np.int64) for k in n])
            out = pd.DataFrame({"token": np.concatenate(firsts), "node": np.repeat(batch["node"].to_numpy(), n), "sp": (np.repeat(np.array(sizes, dtype=np.int64), n) << 32) | pos})
            marked = np.repeat(np.array(marks, dtype=np.uint64).view(np.int64), n, axis=0)
            yield out.assign(**{c: np.where(pos == 0, marked[:, k], 0) for k, c in enumerate(_MARKS)})

    return rows.mapInPandas(run, "token long, node long, sp long, " + ", ".join(f"{c} long" for c in _MARKS))


def majority(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of a set of hashes: the bits that over half of them have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: whether a bin (of 256, by the lowest bits) has an odd number of the hashes."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _alike(a: str, b: str, least: float) -> str:
    """SQL: the parities allow the similarity; of sizes x and y no more than (1 - t) / (1 + t) (x + y) elements may differ."""
    differ = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(4))
    return f"{differ} <= {(1 - least) / (1 + least)!r} * ({a}.size + {b}.size) + {_SLACK!r}"


def _possible(a: str, b: str, least: float) -> str:
    """SQL: the sizes allow the similarity, and so do the elements that follow a first common one."""
    need = f"({least / (1 + least)!r} * ({a}.size + {b}.size) - {_SLACK!r})"
    return f"least({a}.size, {b}.size) >= {least!r} * greatest({a}.size, {b}.size) - {_SLACK!r} AND 1 + least({a}.size - {a}.pos - 1, {b}.size - {b}.pos - 1) >= {need}"


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """fa, fb of the pairs (a, b), a written table, whose texts have this similarity.  Only the texts of pairs travel to their partners."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-wanted")
    texts = written(rows.join(few(wanted), "node", "left_semi"), "similar-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("data").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("data").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for batch in batches:
            similar = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, own = a, shingles(ta, shingle)
                other = shingles(tb, shingle)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                similar.append(shared >= least * (len(own) + len(other) - shared) - _SLACK)
            keep = np.array(similar, dtype=bool)
            yield pd.DataFrame({"fa": batch["a"].to_numpy()[keep], "fb": batch["b"].to_numpy()[keep]})

    found = written(both.mapInPandas(run, "fa long, fb long"), "similar-links")
    discard(texts, wanted)
    return found


def _paired(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Each different pair (a, b) once, smaller node first, if the parities allow the similarity."""
    once = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda name: marks.select(F.col("node").alias(name), F.struct("size", *_MARKS[1:]).alias(f"m{name}"))
    return once.join(side("a"), "a").join(side("b"), "b").filter(_alike("ma", "mb", least)).select("a", "b")


def _close_fingerprints(marks: DataFrame) -> DataFrame:
    """a, b: each node with the first of its fingerprint, and the first nodes of fingerprints that differ in one or two bits."""
    first = written(marks.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "similar-fingerprints")
    same = marks.join(first.filter("n > 1"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("fa"), F.col("first").alias("a")), "fa").join(first.select(F.col("fp").alias("fb"), F.col("first").alias("b")), "fb")
    return same.unionByName(near.select("a", "b"))


def groups(docs: DataFrame, key: str, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """fp, root of each row that is linked to another: its ``key`` (a long, different in each row) and its group's smallest.

    Rows are linked if their texts' shingle sets have a Jaccard similarity of ``least`` or more, and grouped with all
    that can be reached.  A null text counts as empty; texts without words are equal.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 256)
    rows = docs.select(F.col(key).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    kept = written(_entries(rows, shingle, least), "similar-entries")
    marks = written(kept.selectExpr("node", _SIZE, _POS, *_MARKS).filter("pos = 0").drop("pos"), "similar-marks")
    # Entries are dealt by token once: the groups' counts and most typical texts are made of the same dealt rows that they are joined with.
    dealt = kept.select("token", "node", "sp").repartition("token")
    heads = dealt.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(F.expr(_POS), "node", F.expr(_SIZE))).alias("head")).filter("n > 1").drop("n")
    met = written(dealt.join(heads, "token").selectExpr("token", "node", _SIZE, _POS, "head"), "similar-met")
    discard(kept)

    # Close fingerprints, and each text with the most typical of its buckets.
    star = met.alias("x").filter(f"node != head.node AND {_possible('head', 'x', least)}").select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    star = written(_paired(star.unionByName(_close_fingerprints(marks)), marks, least), "similar-star")
    found = _verified(star, rows, shingle, least)

    # Each with all of its buckets that are in another group by now.
    label = components(found)
    plain = written(met.drop("head").join(few(label.withColumnRenamed("fp", "node")), "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-named")
    discard(met, label)
    mixed = written(plain.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token"), "similar-tokens")
    named = written(plain.join(few(mixed), "token", "left_semi").join(marks.drop("size", "fp"), "node"), "similar-mixed")
    discard(plain, mixed)
    one = [F.when(F.count("*") == 1, F.min(c)).alias(c) for c in _MARKS[1:]]  # parities where a group has one text in the bucket
    kinds = named.groupBy("token", "root").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.expr("size - pos")).alias("after"), F.min("size").alias("size"), *one)
    can = f"x.high >= {least!r} * y.low - {_SLACK!r} AND y.high >= {least!r} * x.low - {_SLACK!r} AND least(x.after, y.after) >= {least / (1 + least)!r} * (x.low + y.low) - {_SLACK!r} AND coalesce({_alike('x', 'y', least)}, true)"  # of some two of them
    two = kinds.alias("x").join(kinds.alias("y"), F.expr(f"x.token = y.token AND x.root < y.root AND {can}"))
    two = written(two.select("x.token", "x.root", F.col("y.root").alias("other")), "similar-kinds")
    own = F.struct("node", "size", "pos", *_MARKS[1:])
    x = two.join(named.select("token", "root", own.alias("x")), ["token", "root"]).select("token", "other", "x")
    y = named.select("token", F.col("root").alias("other"), own.alias("y"))
    rest = x.alias("l").join(y.alias("r"), F.expr(f"l.token = r.token AND l.other = r.other AND {_possible('x', 'y', least)} AND {_alike('x', 'y', least)}"))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = written(rest.join(star, ["a", "b"], "left_anti"), "similar-rest")
    discard(two, named, star, marks)
    return components(found.unionByName(_verified(rest, rows, shingle, least)))
