"""From a tick's outcome to the writes it implies: one ordered plan that may be applied again without effect.

Seeds come first, so that every id exists; then tombstones, alert states (deletes, then upserts), memberships under the ids
that live on, and last the aggregates of events that changed.  What the registry already says is not written, so the plan
of an outcome that has been applied is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.joins import closure

#: Steps in their order.
STEPS = ["seed", "tombstone", "delete_state", "upsert_state", "add_member", "aggregate"]
COLUMNS = {"event_id": "long", "zone_id": "long", "uid": "string", "merged_into": "long", "started_s": "long", "last_s": "long", "n": "long", "rank": "int", "notified_s": "long"}
_VALUES = ["started_s", "last_s", "n"]


def _writes(step: str, rows: DataFrame) -> DataFrame:
    have = rows.columns
    return rows.select(F.lit(STEPS.index(step) + 1).alias("step"), F.lit(step).alias("action"), *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def _differs(columns: list[str]) -> Column:
    return reduce(Column.__or__, [~F.col(f"o.{c}").eqNullSafe(F.col(f"e.{c}")) for c in columns])


def write_plan(events: DataFrame, states: DataFrame, members: DataFrame, clusters: DataFrame, merges: DataFrame, assignments: DataFrame) -> DataFrame:
    """step, action and COLUMNS of every write, in no order of rows; steps are to be applied in theirs.

    The registry: events (event_id, merged_into, started_s, last_s, n), states (event_id, zone_id, rank, notified_s),
    members (uid, event_id).  The outcome: clusters (event_id, started_s, last_s, n) that changed or were seeded, absorbed
    seeds among them, merges (absorbed, survivor), assignments (uid, event_id).
    """
    known = events.select("event_id", "merged_into")
    links = merges.select("absorbed", "survivor").unionByName(known.filter("merged_into IS NOT NULL").select(F.col("event_id").alias("absorbed"), F.col("merged_into").alias("survivor")).join(merges.select("absorbed"), "absorbed", "left_anti"))
    ends = closure(links.distinct(), "absorbed", "survivor").select(F.col("alias").alias("event_id"), F.col("canonical").alias("to"))
    seeds = clusters.join(known.select("event_id"), "event_id", "left_anti")
    gone = ends.join(known, "event_id", "left").filter(~F.col("merged_into").eqNullSafe(F.col("to"))).select("event_id", F.col("to").alias("merged_into"))

    absorbed = states.join(ends, "event_id")
    deletes = absorbed.select("event_id", "zone_id")
    touched = absorbed.select(F.col("to").alias("event_id"), "zone_id").distinct()
    every = absorbed.select(F.col("to").alias("event_id"), "zone_id", "rank", "notified_s").unionByName(states.join(touched, ["event_id", "zone_id"], "left_semi").select("event_id", "zone_id", "rank", "notified_s"))
    folded = every.groupBy("event_id", "zone_id").agg(F.max("rank").alias("rank"), F.max("notified_s").alias("notified_s"))
    changed = folded.alias("o").join(states.alias("e"), (F.col("o.event_id") == F.col("e.event_id")) & (F.col("o.zone_id") == F.col("e.zone_id")), "left").filter(F.col("e.event_id").isNull() | _differs(["rank", "notified_s"])).select("o.*")

    live = assignments.join(ends, "event_id", "left").select("uid", F.coalesce("to", "event_id").alias("event_id"))
    fresh = live.join(members.select("uid"), "uid", "left_anti")
    now = clusters.join(ends.select("event_id"), "event_id", "left_anti").alias("o").join(events.alias("e"), "event_id").filter(_differs(_VALUES)).select("event_id", *[F.col(f"o.{c}").alias(c) for c in _VALUES])
    parts = [("seed", seeds), ("tombstone", gone), ("delete_state", deletes), ("upsert_state", changed), ("add_member", fresh), ("aggregate", now)]
    return reduce(DataFrame.unionByName, [_writes(step, rows) for step, rows in parts])


def applied(events: DataFrame, states: DataFrame, members: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, states and members after the plan; applying it again gives the same."""
    of = lambda step, *columns: plan.filter(F.col("action") == step).select(*columns)
    base = events.select("event_id", "merged_into", *_VALUES)
    seeds = of("seed", "event_id", *_VALUES).join(base.select("event_id"), "event_id", "left_anti").withColumn("merged_into", F.lit(None).cast("long"))
    gone = of("tombstone", "event_id", F.col("merged_into").alias("_to"))
    values = of("aggregate", "event_id", *[F.col(c).alias(f"_{c}") for c in _VALUES])
    out = base.unionByName(seeds).join(gone, "event_id", "left").join(values, "event_id", "left")
    now = out.select("event_id", F.coalesce("_to", "merged_into").alias("merged_into"), *[F.coalesce(f"_{c}", c).alias(c) for c in _VALUES])
    keys, rest = ["event_id", "zone_id"], ["rank", "notified_s"]
    put = of("upsert_state", *keys, *rest)
    kept = states.join(of("delete_state", *keys), keys, "left_anti").join(put.select(*keys), keys, "left_anti").select(*keys, *rest).unionByName(put)
    return now, kept, members.select("uid", "event_id").unionByName(of("add_member", "uid", "event_id").join(members.select("uid"), "uid", "left_anti"))
