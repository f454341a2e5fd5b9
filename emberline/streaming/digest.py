"""The daily digest: what is owed to an account at its local hour, once a day, after quiet hours if these are on.

A window opens when local clocks show the hour, so two windows may be 23 or 25 hours apart.  A window in quiet hours waits
and is not used up; one with nothing to say is used up.  ``decisions`` and ``lines`` say so over tables of ticks; ``stream``
does the same with a timer for each account, whose state outlives restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.text import in_quiet_hours, window_start

#: Fixed value: local time at which windows open.
HOUR = "09:00"
KINDS = ["deferred", "seeded", "active"]


def _tries(accounts: DataFrame, zones: DataFrame, ticks: list[int], hour: str) -> DataFrame:
    """account_id, start_s (null: none opened since the account was there), at_s, quiet of each account at each tick."""
    at = accounts.withColumn("at_s", F.explode(F.array(*map(F.lit, ticks))))
    at = at.withColumn("start_s", F.unix_seconds(window_start(F.timestamp_seconds("at_s"), F.col("timezone"), F.lit(hour))))
    at = at.withColumn("start_s", F.when(F.col("start_s") >= F.col("watching_s"), F.col("start_s")))
    silent = at.join(zones, "account_id").groupBy("account_id", "at_s").agg(F.bool_or(in_quiet_hours(F.timestamp_seconds("at_s"), F.col("timezone"), F.col("quiet_from"), F.col("quiet_to"))).alias("quiet"))
    return at.join(silent, ["account_id", "at_s"], "left").select("account_id", "start_s", "at_s", F.coalesce("quiet", F.lit(False)).alias("quiet"))


def _used(tries: DataFrame) -> DataFrame:
    """account_id, start_s, at_s, last_s: the first tick outside quiet hours of each window, and the window used before it."""
    used = tries.filter("start_s IS NOT NULL AND NOT quiet").groupBy("account_id", "start_s").agg(F.min("at_s").alias("at_s"))
    return used.withColumn("last_s", F.lag("start_s").over(Window.partitionBy("account_id").orderBy("start_s")))


def _lines(used: DataFrame, candidates: DataFrame) -> DataFrame:
    owed = F.when(F.col("kind") == "deferred", F.col("last_s").isNull() | (F.col("since_s") >= F.col("last_s"))).when(F.col("kind") == "seeded", F.col("since_s") < F.col("start_s")).otherwise(F.col("kind") == "active")
    due = candidates.join(used, "account_id").filter((F.col("since_s") <= F.col("at_s")) & (F.coalesce("until_s", F.lit(2**62)) > F.col("at_s")) & owed)
    first = F.min(F.struct("distance_m", "zone_id", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "kind")).alias("z")
    return due.groupBy("account_id", "start_s", "event_id").agg(first).select("account_id", "start_s", "event_id", "z.zone_id", "z.distance_m", "z.kind")


def lines(accounts: DataFrame, zones: DataFrame, candidates: DataFrame, ticks: list[int], hour: str = HOUR) -> DataFrame:
    """account_id, start_s, event_id, zone_id, distance_m, kind: a line for each event of each digest, by its nearest zone (then the smallest id).

    accounts: account_id, timezone, watching_s.  zones: account_id, quiet_from, quiet_to.  candidates: account_id, zone_id,
    event_id, distance_m, kind, since_s, until_s (null: still there).  A deferred event is owed since the last window that
    was used, a seeded one from the next window on, an active one always, each while it is there.
    """
    return _lines(_used(_tries(accounts, zones, ticks, hour)), candidates)


def decisions(accounts: DataFrame, zones: DataFrame, candidates: DataFrame, ticks: list[int], hour: str = HOUR) -> DataFrame:
    """account_id, at_s, start_s, outcome (send, hold, suppress, none), entries of every account at every tick."""
    tries = _tries(accounts, zones, ticks, hour)
    used = _used(tries)
    n = _lines(used, candidates).groupBy("account_id", "start_s").agg(F.count("*").alias("entries"))
    at = tries.join(used.select("account_id", "start_s", F.col("at_s").alias("used_s")), ["account_id", "start_s"], "left").join(n, ["account_id", "start_s"], "left")
    entries = F.coalesce("entries", F.lit(0)).cast("long")
    outcome = F.when(F.col("start_s").isNull() | (F.col("at_s") > F.coalesce("used_s", F.lit(2**62))), "none").when(F.col("at_s") < F.coalesce("used_s", F.lit(2**62)), "hold").when(entries > 0, "send").otherwise("suppress")
    told = lambda c: F.when(outcome != "none", c)
    return at.select("account_id", "at_s", told(F.col("start_s")).alias("start_s"), outcome.alias("outcome"), F.when(outcome == "send", entries).otherwise(F.lit(0)).cast("long").alias("entries"))


def opened(at_s: int, zone: str, hour: str = HOUR) -> int:
    """The last instant at or before at_s when local clocks showed the hour; of two such, the first."""
    tz, (h, m) = ZoneInfo(zone), map(int, hour.split(":"))
    day = datetime.fromtimestamp(at_s, tz).date()
    for back in (0, 1, 2):
        start = int((datetime(day.year, day.month, day.day, h, m) - timedelta(days=back)).replace(tzinfo=tz).timestamp())
        if start <= at_s:
            return start
    raise ValueError("no such time of day")


def opens(at_s: int, zone: str, hour: str = HOUR) -> int:
    """The first such instant after at_s."""
    return next(s for s in (opened(at_s + k * 43_200, zone, hour) for k in range(1, 6)) if s > at_s)


def quiet_until(at_s: int, zone: str, spans: list[tuple[str, str]]) -> int | None:
    """When the quiet hours (from, to) that are on end; None if none are on."""

    def minute(hhmm: str) -> int:
        return int(hhmm[:2]) * 60 + int(hhmm[3:])

    tz, ends = ZoneInfo(zone), []
    local = datetime.fromtimestamp(at_s, tz)
    now = local.hour * 60 + local.minute
    for start, end in spans:
        a, b = minute(start), minute(end)
        if a != b and ((a <= now < b) if a < b else (now >= a or now < b)):
            ends.append(opens(at_s, zone, end))
    return max(ends) if ends else None


class DigestProcessor(StatefulProcessor):
    """One account: its zones and what is owed, and a timer that is always set to when something may be due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "timezone string, watching_s long, last_s long")
        self.zones = handle.getMapState("zones", "zone_id long", "quiet_from string, quiet_to string")
        self.owed = handle.getMapState("owed", "zone_id long, event_id long, kind string", "distance_m long, since_s long, until_s long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.entry == "zone":
                    known = self.account.get() if self.account.exists() else None
                    since = int(r.since_s) if known is None else min(int(r.since_s), known[1])
                    self.account.update((r.timezone, since, known[2] if known else -1))
                    self.zones.updateValue((int(r.zone_id),), (r.quiet_from, r.quiet_to))
                    if known is None:
                        now = max(timerValues.getCurrentWatermarkInMs() // 1000, since)
                        first = opened(now, r.timezone)
                        self.handle.registerTimer((first if first >= since else opens(now, r.timezone)) * 1000)
                else:
                    self.owed.updateValue((int(r.zone_id), int(r.event_id), r.kind), (int(r.distance_m), int(r.since_s), -1 if pd.isna(r.until_s) else int(r.until_s)))
        yield pd.DataFrame([], columns=_LINES, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_s, now_s = expiredTimerInfo.getExpiryTimeInMs() // 1000, timerValues.getCurrentWatermarkInMs() // 1000
        rows = []
        while at_s <= now_s:  # what came due while the stream stood still comes due in order
            found, at_s = self._due(at_s)
            rows += [(key[0], *line) for line in found]
        self.handle.registerTimer(at_s * 1000)
        yield pd.DataFrame(rows, columns=_LINES, dtype=object)

    def _due(self, at_s: int) -> tuple[list[tuple], int]:
        """The lines of the window that is open at a moment, if it is to be used then, and when to look again."""
        zone, watching, last = self.account.get()
        start = opened(at_s, zone)
        quiet = quiet_until(at_s, zone, [(a, b) for _, (a, b) in self.zones.iterator()])
        found: dict[int, tuple] = {}
        if start >= watching and start > last and quiet is None:
            for (zone_id, event_id, kind), (distance, since, until) in list(self.owed.iterator()):
                if 0 <= until <= at_s or (kind == "deferred" and since < last):
                    self.owed.removeKey((zone_id, event_id, kind))  # gone, or paid by an earlier window
                elif since <= at_s and (kind != "seeded" or since < start):
                    line = (distance, zone_id, KINDS.index(kind))
                    found[event_id] = min(found.get(event_id, line), line)
            self.account.update((zone, watching, start))
        wake = opens(at_s, zone)
        return [(start, event, z, d, KINDS[k]) for event, (d, z, k) in sorted(found.items())], min(quiet, wake) if quiet else wake


_LINES = ["account_id", "start_s", "event_id", "zone_id", "distance_m", "kind"]


def stream(entries: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The lines of all digests whose windows the stream's time has passed.

    entries: at (timestamp), account_id, entry (zone or candidate), timezone, quiet_from, quiet_to, zone_id, event_id,
    kind, distance_m, since_s, until_s.  Needs the RocksDB state store.
    """
    schema = "account_id long, start_s long, event_id long, zone_id long, distance_m long, kind string"
    return entries.withWatermark("at", lateness).groupBy("account_id").transformWithStateInPandas(DigestProcessor(), schema, "append", "eventTime")
