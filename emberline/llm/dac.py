"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level k of a file holds the k-th chunk of every id that has one, and
a bitmap that says which of them go on; a rank directory counts the bits before every 512th, so that the place of the
i-th id's next chunk is known without decoding what stands before it.

A file (little-endian): ``DAC1``; uint64 documents, tokens; uint32 levels, chunk bits; int64 doc_id and uint8 null flag of
each document; uint64 ends (tokens up to and including each document); for each level uint64 entries, its chunks (uint8),
its bitmap (padded to whole directory blocks) and its directory (uint64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import tokens
from emberline.llm.files import check, get, put
from emberline.llm.shared import arrow_rows, folder

MAGIC, CHUNK_BITS, BLOCK_BITS = b"DAC1", 8, 512
_FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"
_LISTED = "part int, file int, name string, n_tokens long"


def encode_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """One file's bytes."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunk, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(CHUNK_BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK_BITS // 8)))
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    known = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = MAGIC + struct.pack("<QQII", len(doc_ids), len(ids), len(levels), CHUNK_BITS)
    return head + known.tobytes() + null.tobytes() + np.cumsum(lengths, dtype="<u8").tobytes() + b"".join(levels)


class DacFile:
    """Reads one file: any id alone, or all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        docs, self.tokens, levels, _ = struct.unpack_from("<QQII", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.ends = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK_BITS)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK_BITS // 8), take("<u8", blocks + 1)))

    def access(self, i: int) -> int:
        """The i-th id, from one chunk of each of its levels."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = shift = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
            shift += CHUNK_BITS
        return out

    def _rank(self, level: int, i: int) -> int:
        """How many of a level's first i entries go on to the next."""
        _, bitmap, directory = self.levels[level]
        block, byte = i // BLOCK_BITS, i >> 3
        whole = int(np.bitwise_count(bitmap[block * BLOCK_BITS // 8 : byte]).sum())
        part = int(bitmap[byte] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return int(directory[block]) + whole + part

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from one place to another; those that go on stand together on each next level, at the ranks of the ends."""
        if not 0 <= start <= end <= self.tokens:
            raise IndexError((start, end))
        out, where = np.zeros(end - start, dtype=np.uint32), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            bits = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start]
            more = np.flatnonzero(bits)
            if where is None:
                out, where = part, more
            else:
                out[where] |= part
                where = where[more]
            if not len(where):
                break
            start = self._rank(k, start)
            end = start + len(where)
        return out

    def all(self) -> np.ndarray:
        return self.between(0, self.tokens)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, where: str, tokens_per_file: int = 1 << 22) -> DataFrame:
    """Write every text's ids and the end id into files in ascending doc_id order: part, file, name, n_tokens of each file.

    Files are named part-P-F-A.dac; parts are ranges of doc_id, files follow within them, and A is the task's attempt, so
    what a lost attempt has left behind is in no list.  Running this writes them.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task = tokens.load(vocabulary), TaskContext.get()
        part = task.partitionId()
        doc_ids, lengths, held, n, file = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{file:06d}-{task.taskAttemptId()}.dac"
            put(where, name, encode_file(doc_ids, lengths, np.concatenate(held)))
            return pd.DataFrame({"part": [part], "file": [file], "name": [name], "n_tokens": [n]})

        for batch in batches:
            for no_id, doc_id, ids in zip(batch["no_id"], batch["doc_id"], encoder.encode(batch["text"].tolist()), strict=True):
                doc_ids.append(None if no_id else int(doc_id))
                held.append(np.append(ids, np.uint32(end_id)))
                lengths.append(len(held[-1]))
                n += lengths[-1]
                if n >= tokens_per_file:
                    yield flush()
                    doc_ids, lengths, held, n, file = [], [], [], 0, file + 1
        if doc_ids:
            yield flush()

    key = F.col("doc_id").cast("long")
    rows = docs.select(key.isNull().alias("no_id"), F.coalesce(key, F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("_order"))
    rows = rows.repartitionByRange("_order").sortWithinPartitions("_order", "text").select("no_id", "doc_id", "text")
    return rows.mapInPandas(run, _LISTED)


def read_tokens(listed: DataFrame, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the listed files (name, start: how many ids stand before it).

    Each document is fetched by its place alone, through the rank directories.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, before in zip(batch["name"], batch["start"], strict=True):
                f = DacFile(get(where, name))
                starts = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
                checksums = [zlib.crc32(f.between(a, b).astype("<u4", copy=False)) for a, b in zip(starts.tolist(), f.ends.tolist(), strict=True)]
                doc_ids = pd.array(f.doc_ids, dtype="Int64")
                doc_ids[f.null.astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": before + starts, "n_tokens": f.ends - starts, "ids_crc32": checksums})

    tasks = min(max(1, listed.count()), 100 * listed.sparkSession.sparkContext.defaultParallelism)
    return listed.select("name", "start").repartition(tasks).mapInPandas(run, _FOUND)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, tokens_per_file: int = 1 << 22) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files that are written and read back.

    A null or empty text has the end id alone.  doc_ids are longs (or what can be cast to one; else the cast fails).  Null
    doc_ids come first; rows with one id follow each other in the order of their texts.  An empty table writes no file and
    gives an empty result; other columns are not read.  Brought to the driver: one count for each partition.
    """
    spark = docs.sparkSession
    where = folder(spark, "dac")
    check(where)
    listed = f"{where}-list"
    write_tokens(docs, vocabulary, end_id, where, tokens_per_file).write.parquet(listed)
    files = spark.read.schema(_LISTED).parquet(listed)
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each partition
    if not parts:
        return spark.createDataFrame([], _FOUND)
    offsets, total = [], 0
    for part, n in parts:
        offsets.append((part, total))
        total += n
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    starts = spark.createDataFrame(offsets, "part int, part_start long")
    return read_tokens(files.withColumn("before", within).join(starts, "part").select("name", (F.col("part_start") + F.col("before")).alias("start")), where)
