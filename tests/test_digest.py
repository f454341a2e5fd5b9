"""Digests: windows by local clocks, quiet hours that delay, what each kind is owed; and the stream over restarts."""

import json
from datetime import UTC, datetime

import pytest

from emberline.streaming import digest

ENTRY = "at timestamp, account_id long, entry string, timezone string, quiet_from string, quiet_to string, zone_id long, event_id long, kind string, distance_m long, since_s long, until_s long"


def utc(*at):
    return int(datetime(*at, tzinfo=UTC).timestamp())


def test_windows_follow_local_clocks():
    spring, autumn = utc(2027, 3, 28, 12), utc(2026, 10, 25, 12)
    for noon, hours in ((spring, 23), (autumn, 25)):
        start = digest.opened(noon, "Europe/Sofia")
        assert start - digest.opened(start - 1, "Europe/Sofia") == hours * 3600
        assert digest.opens(start - 1, "Europe/Sofia") == start and digest.opens(start, "Europe/Sofia") > start
    assert digest.opened(utc(2026, 10, 25, 1, 30), "Europe/Sofia", "03:30") == utc(2026, 10, 25, 0, 30)  # the first of two
    assert digest.quiet_until(utc(2026, 1, 1, 7), "Europe/Sofia", [("22:00", "10:00"), ("08:00", "09:30")]) == utc(2026, 1, 1, 8)
    assert digest.quiet_until(utc(2026, 1, 1, 8), "Europe/Sofia", [("22:00", "10:00"), ("06:00", "06:00")]) is None


def tables(spark):
    accounts = spark.createDataFrame([(1, "Europe/Sofia", utc(2026, 1, 1)), (2, "Europe/Sofia", utc(2026, 1, 2, 8)), (3, "America/New_York", utc(2026, 1, 1))], "account_id long, timezone string, watching_s long")
    zones = spark.createDataFrame([(1, "06:00", "06:00"), (2, "22:00", "10:00"), (3, "01:00", "02:00"), (1, "00:00", "01:00")], "account_id long, quiet_from string, quiet_to string")
    candidates = [
        (1, 10, 100, 5000, "active", utc(2026, 1, 1), utc(2026, 1, 3, 8)), (1, 11, 100, 900, "deferred", utc(2026, 1, 1, 20), None), (1, 11, 101, 900, "deferred", utc(2026, 1, 1, 5), None),
        (2, 20, 100, 700, "seeded", utc(2026, 1, 3, 7, 30), None), (2, 21, 100, 700, "seeded", utc(2026, 1, 2, 9), None), (3, 30, 102, 10, "active", utc(2026, 1, 9), None),
    ]
    return accounts, zones, spark.createDataFrame(candidates, "account_id long, zone_id long, event_id long, distance_m long, kind string, since_s long, until_s long")


def ticks():
    return [utc(2026, 1, d, h, 10) for d in (1, 2, 3) for h in range(24)]


def test_decisions_and_lines(spark):
    of = tables(spark)
    got = {(r["account_id"], r["at_s"]): (r["start_s"], r["outcome"], r["entries"]) for r in digest.decisions(*of, ticks()).collect()}
    assert len(got) == 3 * 72
    start = [utc(2026, 1, d, 7) for d in (1, 2, 3)]  # 09:00 in Sofia
    assert [got[1, s + 600] for s in start] == [(start[0], "send", 2), (start[1], "send", 1), (start[2], "send", 1)]
    assert got[1, start[0] - 3000] == got[1, start[0] + 4200] == (None, "none", 0)
    assert [got[2, start[k] + 600][1] for k in (0, 1, 2)] == ["none", "none", "hold"] and got[2, start[2] + 4200] == (start[2], "send", 1)
    assert got[3, utc(2026, 1, 1, 14, 10)] == (utc(2026, 1, 1, 14), "suppress", 0)
    found = sorted((r["account_id"], r["start_s"], r["event_id"], r["zone_id"], r["kind"]) for r in digest.lines(*of, ticks()).collect())
    assert found == [
        (1, start[0], 100, 10, "active"), (1, start[0], 101, 11, "deferred"), (1, start[1], 100, 11, "deferred"), (1, start[2], 100, 10, "active"), (2, start[2], 100, 21, "seeded"),
    ]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_the_stream_gives_the_same_over_restarts(spark, tmp_path, rocks):
    accounts, zones, candidates = tables(spark)
    rows = []
    home = {r["account_id"]: (r["timezone"], r["watching_s"]) for r in accounts.collect()}
    for k, z in enumerate(zones.collect()):
        rows.append((home[z["account_id"]][1], {"account_id": z["account_id"], "entry": "zone", "timezone": home[z["account_id"]][0], "quiet_from": z["quiet_from"], "quiet_to": z["quiet_to"], "zone_id": k, "since_s": home[z["account_id"]][1]}))
    rows += [(c["since_s"], {"entry": "candidate", **c.asDict()}) for c in candidates.collect()]
    rows += [(utc(2026, 1, d, 23), {"account_id": 9, "entry": "candidate", "zone_id": 0, "event_id": 0, "kind": "active", "distance_m": 0, "since_s": 2**40}) for d in (1, 2, 3)]  # time passes
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    for day in (1, 2, 3):  # a restart each day
        part = [{"at": datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), **r} for at, r in rows if (utc(2026, 1, day) <= at < utc(2026, 1, day + 1))]
        (landing / f"{day}.json").write_text("\n".join(map(json.dumps, part)))
        query = digest.stream(spark.readStream.schema(ENTRY).json(str(landing)), "0 seconds")
        query.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    got = sorted((r["account_id"], r["start_s"], r["event_id"], r["zone_id"], r["kind"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["account_id"], r["start_s"], r["event_id"], r["zone_id"], r["kind"]) for r in digest.lines(accounts, zones, candidates, ticks()).collect())
    assert got == want
