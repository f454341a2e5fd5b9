"""WARC archives: written record by record, and read back by a reader that salvages what damage has left.

Each record is written as a gzip member of its own; the reader takes members of any number of records.  When a member or a
record fails its checks, the reader searches for the next member that inflates to a record (or, within what is inflated
and in plain archives, the next version line whose record is whole), goes on there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.files import check, get, put
from emberline.llm.shared import arrow_rows, folder, written

VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"
_START = re.compile(rb"WARC/1\.[01]\r\n")
#: Compressed bytes that are inflated at a time, and inflated bytes that are taken at a time.
_WINDOW, _STEP = 1 << 16, 1 << 24
#: Inflated bytes of one record at most, and of its header.
MOST, _HEADER = 1 << 28, 1 << 16
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)
_LISTED = "name string, records long, bytes long"
_READ = "archive string, kind string, from_byte long, to_byte long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record; ``response`` is the page that a revisit refers to.  A revisit has no payload, but tells its length."""
    kind = "response" if response is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"\s+", "%20", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if response is not None:
        fields += [("WARC-Refers-To", f"<{_URN}{response}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = payload if response is None else b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """The record at a place: its fields, its block and where it ends; None if it fails a check."""
    if not _START.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or not length.isascii() or "warc-type" not in fields:
        return None
    stop = end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[end + 4 : stop]
    told = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and told.startswith("sha1:") and told[5:] != digest_of(block):
        return None
    return fields, block, stop + 4


def _within(data: bytes, at: int, ended: bool, most: int) -> tuple[dict[str, str], bytes, int] | int | None:
    """The record at a place of inflated bytes, or where to look on if there is none, or None if more bytes are needed."""

    def on() -> int:
        after = _START.search(data, at + 1)
        return after.start() if after else len(data) if ended else max(at + 1, len(data) - len(VERSION) - 1)  # a version line may be cut in two

    if not _START.match(data, at):
        return None if len(data) - at < len(VERSION) + 2 and not ended else on()
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None if len(data) - at <= _HEADER and not ended else on()
    told = _LENGTH.search(data, at, end + 2)
    if told is None or (stop := end + 8 + int(told[1])) - at > most:
        return on()
    if stop > len(data) and not ended:
        return None
    return parse(data, at) or on()


def _until_damage(unpacker, window: bytes) -> bytes:
    """What a window gives before the place where it can't be inflated."""
    more = []
    for k in range(0, len(window), 16):
        try:
            more.append(unpacker.decompress(window[k : k + 16], _STEP))
        except zlib.error:
            break
    return b"".join(more)


def _member(data: bytes, at: int, most: int) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Fields, block and end of each record in the gzip member at a place, as they are inflated; returns (end, from, whole).

    A record is given once another follows or the member has passed its checksum, so that a member's only record needs
    that.  end is where the member ends or breaks off; from, where the bytes begin that gave no record (end, if all did);
    whole, whether the member's checksum holds.
    """
    unpacker, view = zlib.decompressobj(31), memoryview(data)
    buffer, fresh, held, lost, ended = bytearray(), at, None, None, False
    while not ended:
        tail = unpacker.unconsumed_tail
        window = tail or view[at : at + _WINDOW]
        behind, at = at, at if tail else at + len(window)
        before = unpacker.copy()
        try:
            more = unpacker.decompress(window, _STEP)
        except zlib.error:
            unpacker, ended = before, True
            more = _until_damage(unpacker, window)
        ended = ended or unpacker.eof or not (len(window) or more)  # or the archive breaks off
        buffer += more
        place = at - len(unpacker.unused_data) if unpacker.eof else behind  # within a window no place is known
        here = 0
        while here < len(buffer):
            found = _within(buffer, here, ended, most)
            if found is None:
                break
            if isinstance(found, int):
                here, lost = found, behind if lost is None else lost
                continue
            if held:
                yield held
                fresh = held[2]
            held = found[0], bytes(found[1]), place
            here = found[2]
        rest = len(buffer) - here
        del buffer[:here]
    end = at - len(unpacker.unused_data)
    if unpacker.eof and held:
        yield held
        fresh = held[2]
    return end, lost if lost is not None else end if unpacker.eof and held and not rest else fresh, unpacker.eof


def salvage(data: bytes, most: int = MOST) -> Iterator[tuple[str, dict[str, str], bytes, int, int]]:
    """("record", fields, block, from, to) and ("gap", {}, b"", from, to), in order, over all bytes of an archive.

    Members may hold any number of records, whose places then are those of the bytes that were inflated together.  Of a
    damaged member the records before the damage are given, and in one that holds rubbish the reader goes on at the next
    version line; either is logged as a gap.  ``most`` is the ceiling on a record's inflated bytes, and so on what is
    held: a longer record is a gap.
    """
    at, gap = 0, None
    zipped = data.find(_MEMBER) >= 0 and (not _START.search(data) or data.startswith(_MEMBER))
    while 0 <= at < len(data):
        if zipped:
            end, clean, lost = at, at, at
            if data.startswith(_MEMBER, at):
                records = _member(data, at, most)
                while True:
                    try:
                        fields, block, stop = next(records)
                    except StopIteration as told:
                        end, lost, whole = told.value
                        break
                    if gap is not None:
                        yield "gap", {}, b"", gap, at
                        gap = None
                    yield "record", fields, block, clean, stop
                    clean = stop
                if whole and lost == end:
                    at = end
                    continue
                gap = lost if gap is None else gap
                if whole:  # its checksum holds, so nothing else starts within it
                    at = end
                    continue
            gap = at if gap is None else gap
            at = data.find(_MEMBER, at + 1)
        elif own := parse(data, at):
            if gap is not None:
                yield "gap", {}, b"", gap, at
                gap = None
            yield "record", own[0], own[1], at, own[2]
            at = own[2]
        else:
            gap = at if gap is None else gap
            after = _START.search(data, at + 1)
            at = after.start() if after else -1
    if gap is not None:
        yield "gap", {}, b"", gap, len(data)


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of each row.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is the response; of
    repeated rows with that page_id each is one.  Only digests, ids and sizes are grouped, summed where they stand.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    largest = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    ids = rows.select("page_id", "digest").join(largest, "digest").filter("page_id IS NULL OR page_id < last").select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "last").distinct()
    return rows.join(ids, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left").select("page_id", "url", "payload", F.col("last").alias("refers_to"))


def write_archives(records: DataFrame, where: str, bytes_per_file: int = 1 << 24) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) as archives part-P-F-A.warc.gz: name, records, bytes of each.

    A is the task's attempt, so what a lost attempt has left behind is in no list.
    """
    arrow_rows(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, file, held, size = TaskContext.get(), 0, [], 0

        def flush() -> pd.DataFrame:
            name, data = f"part-{task.partitionId():06d}-{file:06d}-{task.taskAttemptId()}.warc.gz", b"".join(held)
            put(where, name, data)
            return pd.DataFrame({"name": [name], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for no_id, page_id, url, payload, no_ref, ref in zip(batch["no_id"], batch["page_id"], batch["url"], batch["payload"], batch["no_ref"], batch["refers_to"], strict=True):
                held.append(member(record(None if no_id else int(page_id), url, payload, digest_of(payload), None if no_ref else int(ref))))
                size += len(held[-1])
                if size >= bytes_per_file:
                    yield flush()
                    held, size, file = [], 0, file + 1
        if held:
            yield flush()

    rows = records.select(F.col("page_id").isNull().alias("no_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "payload", F.col("refers_to").isNull().alias("no_ref"), F.coalesce(F.col("refers_to").cast("long"), F.lit(0)).alias("refers_to"))
    return rows.mapInPandas(run, _LISTED)


def read_archives(spark: SparkSession, where: str, listed: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """archive, kind (record or gap), from_byte, to_byte, page_id, url, record_type, payload_bytes, payload_digest, refers_to (and the payload).

    Reads the archives of a folder: those listed (column name), or all whose name has .warc in it.  One file is a task's
    work at a time.
    """

    def number(urn: str) -> int | None:
        text = urn.strip("<>").removeprefix(_URN)
        return int(text) if text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                rows = []
                for kind, fields, block, start, end in salvage(get(where, name)):
                    told = fields.get("warc-payload-length", "")
                    length = None if kind == "gap" else len(block) if fields["warc-type"] == "response" else int(told) if told.isdigit() else None
                    rows.append((name, kind, start, end, number(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), fields.get("warc-type"), length, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(fields.get("warc-refers-to", "")), *([block] if payloads else [])))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    schema = _READ + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    if listed is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(where)
        listed = found.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    tasks = min(max(1, listed.count()), 100 * spark.sparkContext.defaultParallelism)
    return listed.select("name").repartition(tasks).mapInPandas(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, from archives written and read back.

    A null html is an empty payload; null page_ids are written without a number and revisit a numbered page if there is
    one with their payload.  Repeated rows have a record each.  An empty table writes no archive and gives an empty
    result; page_ids are longs, and other columns than page_id, url and html are not read.  Gaps in the archives are
    written to a table beside them (see ``read_back``), and fewer records than were written are an error.
    """
    spark = pages.sparkSession
    where = folder(spark, "warc")
    check(where)
    write_archives(with_responses(pages, least_bytes), where).write.parquet(f"{where}-list")
    return read_back(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_back(spark: SparkSession, where: str) -> DataFrame:
    """The records of the listed archives in a folder, whose list is beside it; their gaps go to the table FOLDER-quarantine.

    Raises ValueError if the archives don't hold as many records as the list says, and names the quarantine.
    """
    listed = spark.read.schema(_LISTED).parquet(f"{where}-list")
    found = written(read_archives(spark, where, listed), "warc-read")
    found.filter("kind = 'gap'").select("archive", "from_byte", "to_byte").write.parquet(f"{where}-quarantine")
    records = found.filter("kind = 'record'")
    want, have = listed.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if have != want:
        raise ValueError(f"{have} of {want} records could be read; the gaps are in {where}-quarantine")
    return records
