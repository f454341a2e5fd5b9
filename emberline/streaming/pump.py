"""A feed of changes by sequence number: a streaming source with seq as its offset, frames that clients get, and their replay.

The source reads a table of changes (Parquet) in batches of so many sequence numbers, each batch in parts of its own that
executors read.  What one change becomes depends on what its event was before, which is the state of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "seq long, event_id long, status string, tier string, merged_into long, invalidated boolean"
FRAMES = "seq long, kind string, event_id long, status string, previous_status string, merged_into long"


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _ChangeReader(DataSourceStreamReader):
    """Offsets are the seq up to which changes were given.  The last committed one is kept in a file, where a new reader goes on."""

    def __init__(self, options: dict):
        self.table, self.cursor = options["path"], f"{options['cursor'].rstrip('/')}/committed.json"
        self.limit, self.parts = int(options.get("limit", "10000")), int(options.get("parts", "4"))
        store, path = fs.FileSystem.from_uri(self.cursor)
        self.at = json.loads(store.open_input_stream(path).read())["seq"] if store.get_file_info(path).type == fs.FileType.File else -1

    def _dataset(self) -> ds.Dataset:
        store, path = fs.FileSystem.from_uri(self.table)
        return ds.dataset(path, format="parquet", filesystem=store)

    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        """The next batch's end: the highest seq there is within the limit of the last end, or beyond a gap the next one there is."""
        seqs = self._dataset()
        within = (ds.field("seq") > self.at) & (ds.field("seq") <= self.at + self.limit)
        end = max((pc.max(b["seq"]).as_py() for b in seqs.to_batches(columns=["seq"], filter=within) if len(b)), default=None)
        if end is None:
            end = min((pc.min(b["seq"]).as_py() for b in seqs.to_batches(columns=["seq"], filter=ds.field("seq") > self.at) if len(b)), default=self.at)
        self.at = end
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["seq"], end["seq"]
        self.at = max(self.at, high)
        edges = [low + (high - low) * k // self.parts for k in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = self._dataset().to_batches(columns=[c.split()[0] for c in CHANGES.split(", ")], filter=(ds.field("seq") > partition.low) & (ds.field("seq") <= partition.high))
        yield from (b for b in rows if len(b))

    def commit(self, end: dict) -> None:
        store, path = fs.FileSystem.from_uri(self.cursor)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}.next") as out:
            out.write(json.dumps(end).encode())
        store.move(f"{path}.next", path)


class ChangeFeed(DataSource):
    """Options: path (a table of CHANGES, rows in no order), cursor (a folder), limit (sequence numbers of a batch), parts."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangeReader(self.options)


def _kind(known: Column, previous: Column) -> Column:
    """What a change becomes; null for none (an event that leaves the map without a merge)."""
    on_map = F.col("merged_into").isNull() & (F.col("tier") == "map") & ~F.col("invalidated")
    return F.when(F.col("merged_into").isNotNull(), "merged").when(~F.coalesce(on_map, F.lit(False)), None).when(~known, "created").when(previous != F.col("status"), "status_changed").otherwise("updated")


def frames(changes: DataFrame) -> DataFrame:
    """FRAMES of a whole table of changes, by the change before of the same event."""
    w = Window.partitionBy("event_id").orderBy("seq")
    on_map = F.coalesce(F.col("merged_into").isNull() & (F.col("tier") == "map") & ~F.col("invalidated"), F.lit(False))
    at = changes.withColumns({"_was": F.coalesce(F.lag(on_map).over(w), F.lit(False)), "_status": F.lag("status").over(w)})
    at = at.withColumn("kind", _kind(F.col("_was"), F.col("_status"))).filter("kind IS NOT NULL")
    return at.select("seq", "kind", "event_id", "status", F.when(F.col("kind") == "status_changed", F.col("_status")).alias("previous_status"), "merged_into")


#: Events of neighbouring numbers that share a state, so that a call is made for so many of them; a state is no larger than that.
TOGETHER = 256


def _projected(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = dict(json.loads(state.get[0])) if state.exists else {}
    rows, plain = [], lambda x: None if x is None or x is pd.NA or x != x else x
    changes = [r for b in batches for r in zip(*[b[c.split()[0]].tolist() for c in CHANGES.split(", ")], strict=True)]
    for seq, event, status, tier, merged_into, invalidated in sorted(changes, key=lambda r: r[0]):
        event, status, merged_into, invalidated = map(plain, (event, status, merged_into, invalidated))
        was = known.get(event)
        if merged_into is not None:
            rows.append((seq, "merged", event, status, None, merged_into))
            known.pop(event, None)
        elif tier != "map" or invalidated is None or invalidated:
            known.pop(event, None)
        else:
            kind = "created" if was is None else "status_changed" if was != status else "updated"
            rows.append((seq, kind, event, status, was if kind == "status_changed" else None, None))
            known[event] = status
    state.update((json.dumps(list(known.items())),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")]).astype({"seq": "int64", "event_id": "Int64", "merged_into": "Int64"})


def pump(spark: SparkSession, table: str, where: str, limit: int = 10_000) -> StreamingQuery:
    """Turn changes into frames in ``where``/frames as they come, from where the last query stopped."""
    spark.dataSource.register(ChangeFeed)
    feed = spark.readStream.format("change_feed").option("cursor", f"{where}/cursor").option("limit", limit).load(table)
    out = feed.withColumn("_events", F.floor(F.col("event_id") / TOGETHER)).groupBy("_events").applyInPandasWithState(_projected, FRAMES, "known string", "append", GroupStateTimeout.NoTimeout)
    return out.writeStream.option("checkpointLocation", f"{where}/offsets").format("parquet").option("path", f"{where}/frames").trigger(processingTime="0 seconds").start()


def replays(frames_: DataFrame, clients: DataFrame, capacity: int, seed: int = 0) -> DataFrame:
    """client_id, outcome (replay, too_old, unknown), frames (how many to send) of each client (client_id, last_seq).

    The ring holds the newest ``capacity`` frames; its floor is the frame that left it last, or the seed.  A client past the
    newest frame, or without a number, is unknown.
    """
    newest = frames_.select("seq").orderBy(F.desc("seq")).limit(capacity + 1)  # a bounded ring
    ring = newest.agg(F.sort_array(F.collect_list("seq"), asc=False).alias("all"))
    ring = ring.select(F.slice("all", 1, capacity).alias("held"), F.when(F.size("all") > capacity, F.element_at("all", -1)).otherwise(seed).alias("floor"))
    at, newest_seq = F.col("last_seq"), F.coalesce(F.get("held", F.lit(0)), F.col("floor"))
    outcome = F.when(at.isNull() | (at < 0) | (at > newest_seq), "unknown").when(at < F.col("floor"), "too_old").otherwise("replay")
    found = clients.crossJoin(F.broadcast(ring)).withColumn("outcome", outcome)  # one row
    return found.select("client_id", "outcome", F.when(F.col("outcome") == "replay", F.size(F.filter("held", lambda s: s > at))).otherwise(0).cast("long").alias("frames"))
