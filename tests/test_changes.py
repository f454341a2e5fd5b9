"""The consumer of changes: the newest of each key once, late ones never, a repeated batch without effect."""

import json

from pyspark.sql import functions as F

from emberline.streaming import changes

SCHEMA = "key long, seq long, status string"


def sends(df):
    return df.filter("row.status != 'quiet'").select("key", "seq", F.col("row.status").alias("status"))


def test_changes_are_taken_once(spark, tmp_path):
    landing, where = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("key", "seq", "status"), r, strict=True))) for r in rows))
        changes.consume(spark, str(landing), SCHEMA, where, sends).awaitTermination()
        return sorted((r["key"], r["seq"], r["status"]) for r in spark.read.parquet(f"{where}/outbox").collect())

    first = [(1, 10, "new"), (2, 11, "quiet"), (3, 12, "new")]
    assert land("a.json", [(1, 9, "old"), (1, 10, "new"), (2, 11, "quiet"), (3, 12, "new")]) == first[:1] + first[2:]
    assert land("b.json", [(3, 8, "late"), (2, 13, "new"), (1, 10, "again")]) == [(1, 10, "new"), (2, 13, "new"), (3, 12, "new")]
    again = spark.createDataFrame([(3, 8, "late"), (2, 13, "new"), (1, 10, "again")], SCHEMA)
    changes.consume_batch(again, 1, where, sends)
    assert spark.read.parquet(f"{where}/outbox").count() == 3 and spark.read.parquet(f"{where}/cursor").filter("batch = 1").count() == 1
    changes.consume_batch(again.limit(0), 2, where, sends)
    assert spark.read.parquet(f"{where}/outbox").count() == 3
