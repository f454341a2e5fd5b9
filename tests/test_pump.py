"""The change feed: batches of bounded size, restarts, frames by what was before, and replay from the ring."""

import random

from emberline.streaming import changes, pump


def rows(low, high):
    rng = random.Random(4)
    return [r for r in ((s, rng.randrange(9), rng.choice("abc"), rng.choice(["map", "map", "feed"]), rng.choice([None, None, None, 5]), rng.random() < 0.1) for s in range(1, 400) if s % 5) if low <= r[0] < high]


def plain(changes_):
    known, out = {}, []
    for seq, event, status, tier, merged, invalid in sorted(changes_):
        if merged is not None:
            known.pop(event, None)
            out.append((seq, "merged", event, status, None, merged))
        elif tier != "map" or invalid:
            known.pop(event, None)
        else:
            was = known.get(event)
            kind = "created" if was is None else "status_changed" if was != status else "updated"
            out.append((seq, kind, event, status, was if kind == "status_changed" else None, None))
            known[event] = status
    return out


def test_frames_of_a_table(spark):
    got = pump.frames(spark.createDataFrame(rows(0, 400), pump.CHANGES).repartition(3))
    assert sorted(map(tuple, got.collect())) == plain(rows(0, 400))
    assert pump.frames(spark.createDataFrame([], pump.CHANGES)).collect() == []


def test_the_pump_over_restarts(spark, tmp_path):
    table, where = f"file://{tmp_path}/table", f"file://{tmp_path}/out"
    for low, high in ((0, 150), (150, 151), (151, 400)):
        spark.createDataFrame(rows(low, high), pump.CHANGES).write.mode("append").parquet(table)
        query = pump.pump(spark, table, where, limit=40)
        query.processAllAvailable()
        sizes = [p["numInputRows"] for p in query.recentProgress]
        query.stop()
        assert max(sizes, default=0) <= 40
        got = spark.read.schema(pump.FRAMES).parquet(f"{where}/frames")
        assert sorted(map(tuple, got.collect())) == plain(rows(0, high))


def test_gaps_in_the_numbers(spark, tmp_path):
    table, where = f"file://{tmp_path}/table", f"file://{tmp_path}/out"
    far = [(3, 1, "a", "map", None, False), (90_000, 1, "b", "map", None, False)]
    spark.createDataFrame(far, pump.CHANGES).write.parquet(table)
    query = pump.pump(spark, table, where, limit=10)
    query.processAllAvailable()
    query.stop()
    assert [r["kind"] for r in spark.read.schema(pump.FRAMES).parquet(f"{where}/frames").orderBy("seq").collect()] == ["created", "status_changed"]


def test_replays(spark):
    frames = spark.createDataFrame([(s,) for s in (10, 20, 30, 40)], "seq long")
    clients = spark.createDataFrame([(1, 40), (2, 41), (3, 20), (4, 19), (5, None), (6, -1), (7, 35), (8, 10)], "client_id long, last_seq long")
    got = {r["client_id"]: (r["outcome"], r["frames"]) for r in pump.replays(frames, clients, 2).collect()}
    assert got == {1: ("replay", 0), 2: ("unknown", 0), 3: ("replay", 2), 4: ("too_old", 0), 5: ("unknown", 0), 6: ("unknown", 0), 7: ("replay", 1), 8: ("too_old", 0)}
    empty = {r["client_id"]: r["outcome"] for r in pump.replays(frames.limit(0), clients, 2, seed=35).collect()}
    assert empty[7] == "replay" and empty[1] == "unknown" and empty[3] == "too_old"


def test_the_cursor_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT", 2)
    where, seen = str(tmp_path / "out"), []
    batches = [[(1, 1), (2, 2)], [(1, 3), (2, 2)], [(1, 2), (3, 4)], [(1, 3), (3, 5)], [(2, 1), (1, 9)], [(1, 9), (2, 6)]]
    for k, part in enumerate(batches):
        for _ in range(2):  # each batch comes again
            changes.consume_batch(spark.createDataFrame(part, "key long, seq long"), k, where, lambda df: df.select("key", "seq"))
        seen.append(sorted((r["key"], r["seq"]) for r in spark.read.parquet(f"{where}/outbox").filter(f"batch = {k}").collect()))
    assert seen == [[(1, 1), (2, 2)], [(1, 3)], [(3, 4)], [(3, 5)], [(1, 9)], [(2, 6)]]
    assert spark.read.parquet(f"{where}/cursor-whole").filter("batch = 4").count() == 3
