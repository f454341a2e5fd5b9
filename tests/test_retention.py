"""Sliding retention: overlapping fetches in any order, late products once, past ones never; over restarts."""

import json
import random

from emberline.streaming import retention

KEPT = 3000


def product(start, number, published, available, at=None):
    return {"start_s": start, "end_s": start + 600, "id": f"p{number}", "published_s": published, "available_s": available, "flashes": [{"at_s": start + 5 if at is None else at, "x": 1, "y": 2}]}


def plain(products, now):
    best = {}
    for p in products:
        if p["end_s"] > now - KEPT:
            k = (p["published_s"] is not None, p["published_s"] or 0, p["available_s"], p["id"])
            if p["start_s"] not in best or k > best[p["start_s"]][0]:
                best[p["start_s"]] = (k, p["id"], sum(f["at_s"] > now - KEPT for f in p["flashes"]))
    return {s: v[1:] for s, v in best.items()}


def rows(df):
    return {r["start_s"]: (r["id"], len(r["flashes"])) for r in df.collect()}


def test_order_does_not_matter(spark):
    rng = random.Random(2)
    products = [product(600 * rng.randrange(12), k, rng.choice([None, 5, 7]), rng.randrange(3), 600 * rng.randrange(12)) for k in range(80)]
    for now in (600, 5000, 7200, 99_999):
        for _ in range(2):
            rng.shuffle(products)
            table = spark.createDataFrame([tuple(p.values()) for p in products], retention.PRODUCTS)
            assert rows(retention.held(table, now, KEPT)) == plain(products, now)


def test_late_and_past_products(spark, tmp_path):
    landing, where = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    landed = []

    def land(name, *products):
        landed.extend(products)
        (landing / name).write_text("\n".join(map(json.dumps, products)))
        retention.slide(spark, str(landing), where, KEPT).awaitTermination()
        return rows(retention.document(spark, where, max(p["end_s"] for p in landed), KEPT))

    assert land("a.json", product(0, 1, None, 10), product(600, 2, 50, 10), product(6000, 3, 50, 10)) == {6000: ("p3", 1)}
    late = product(4200, 4, 60, 20)  # inside the retention, which now reaches back to 3600
    assert land("b.json", late) == {6000: ("p3", 1), 4200: ("p4", 1)} == plain(landed, 6600)
    assert land("c.json", product(4200, 5, 59, 99), product(4200, 6, 60, 21), product(600, 7, 99, 99)) == {6000: ("p3", 1), 4200: ("p6", 1)}
    batches = spark.read.parquet(f"{where}/held").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in batches}.get("p7") is None  # past the watermark: never taken
    assert land("d.json", late) == {6000: ("p3", 1), 4200: ("p6", 1)}
    assert land("e.json", product(9000, 8, None, 1)) == {9000: ("p8", 1)} | {}
    assert retention.document(spark, str(tmp_path / "none"), 0, KEPT).collect() == []
