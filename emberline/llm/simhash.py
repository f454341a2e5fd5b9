"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in at most two bits either differ in at most one of the upper 32 or agree in the lower 32.  So
each distinct fingerprint is indexed by both halves; it asks the upper index for its own half and for its half with one
bit set (the other of such a pair asks nothing, or would ask twice), and the lower index for its own half.  What the
indexes return is verified on all 64 bits.  Where an index bucket is crowded, those who ask it enumerate the other half
too and look up whole fingerprints, so the work grows with the number of fingerprints, never with a bucket's square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import arrow_rows, written
from emberline.operators import graph

SEED, SHINGLE = 42, 3
#: Fingerprints in an index bucket from which whole fingerprints are looked up instead.
CROWDED = 64
_HASHES = 1 << 17


def fingerprints(texts: Iterator[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out, hashes, sizes, digest = [], [], [], xxhash.xxh64_intdigest

    def flush() -> None:
        n = np.array(sizes, dtype=np.int64)
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros((len(n), 64), dtype=np.int64)
        some = np.flatnonzero(n)
        if len(some):
            ones[some] = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel())
        hashes.clear()
        sizes.clear()

    for text in texts:
        words = text.lower().split()  # of bytes: A-Z, and white space as the contract has it
        whole = b" ".join(words)
        if len(words) <= shingle:
            found = [digest(whole, SEED)] if words else []
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            found = [digest(whole[a:b], SEED) for a, b in zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        hashes.extend(found)
        sizes.append(len(found))
        if len(hashes) >= _HASHES:
            flush()
    if sizes:
        flush()
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; null and wordless texts have fingerprint zero."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": fingerprints(batch["data"]).view(np.int64)})

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, f"doc_id {kind}, fp long")


def _flips(value: str, bits: int, only_unset: bool = True) -> str:
    """SQL: the array of a value's variants with one of its low ``bits`` bits set (those that were not)."""
    each = f"filter(sequence(0, {bits - 1}), i -> (shiftright({value}, i) & 1L) = 0)" if only_unset else f"sequence(0, {bits - 1})"
    return f"transform({each}, i -> {value} ^ shiftleft(1L, i))"


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """fa, fb of every two different fingerprints (column fp, each once) that differ in at most two bits, each pair once."""
    halves = distinct.selectExpr("fp", "shiftrightunsigned(fp, 32) AS hi", "fp & 4294967295L AS lo")
    differ = "bit_count(fp ^ other)"

    # Upper half: 0 or 1 bits of it differ.  d counts them.
    crowds_hi = halves.groupBy("hi").count().filter(F.col("count") > crowded).select("hi")
    asks = halves.selectExpr("fp", "lo", "hi AS own", f"explode(concat(array(hi), {_flips('hi', 32)})) AS hi")
    entries = halves.selectExpr("hi", "fp AS other").join(crowds_hi, "hi", "left_anti")
    quiet = asks.join(entries, "hi").filter(f"{differ} <= 2 AND (own != hi OR fp < other)").select("fp", "other")
    # Lower half of a crowded bucket: up to 2 - d bits of it differ, all of them tried, in both directions.
    low = "explode(concat(array(lo), transform(sequence(0, 31), i -> lo ^ shiftleft(1L, i)), if(own != hi, CAST(array() AS array<bigint>), flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> lo ^ shiftleft(1L, i) ^ shiftleft(1L, j))))))) AS lo"
    tried = asks.join(crowds_hi, "hi", "left_semi").selectExpr("fp", "own", "hi", low).selectExpr("fp", "own = hi AS same", "shiftleft(hi, 32) | lo AS other").filter("NOT same OR fp < other").select("fp", "other")
    busy = tried.join(distinct.select(F.col("fp").alias("other")), "other").select("fp", "other")

    # Lower half the same, both bits in the upper half.
    crowds_lo = halves.groupBy("lo").count().filter(F.col("count") > crowded).select("lo")
    calm = halves.join(crowds_lo, "lo", "left_anti")
    lower = calm.selectExpr("lo", "fp").join(calm.selectExpr("lo", "fp AS other"), "lo").filter(f"fp < other AND {differ} = 2").select("fp", "other")
    two = "explode(flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> fp ^ shiftleft(1L, i + 32) ^ shiftleft(1L, j + 32))))) AS other"
    tried_lo = halves.join(crowds_lo, "lo", "left_semi").selectExpr("fp", two).filter("fp < other")
    busy_lo = tried_lo.join(distinct.select(F.col("fp").alias("other")), "other").select("fp", "other")

    every = quiet.unionByName(busy).unionByName(lower).unionByName(busy_lo)
    return every.select(F.least("fp", "other").alias("fa"), F.greatest("fp", "other").alias("fb")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root of each node of the edges (fa, fb): the smallest node that can be reached, in rounds that grow with a logarithm."""
    found = graph.stars(edges.select(F.col("fa").alias("x"), F.col("fb").alias("y")))
    out = found.withColumnRenamed("node", "fp")
    out._scratch = found._scratch
    return out


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component_size (rows) of each row.

    component_id is the smallest doc_id of all rows whose fingerprints are linked to the row's, directly or by others
    (null only where all of them are null).  Equal fingerprints, repeated rows among them, are linked.  An empty table
    gives an empty result; other columns are not read.
    """
    rows = written(fingerprinted(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints-distinct")
    roots = components(written(links(distinct.select("fp"), crowded), "pairs"))
    rooted = written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n"), "roots")
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    labelled = rooted.join(whole, "root").select("fp", "component_id", "component_size")
    return rows.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
