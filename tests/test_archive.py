"""Archives: whole generations or none, hashes checked before rows, folders pruned."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.sources import archive


@pytest.fixture
def rows(spark):
    return spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("product"), (2020 + F.col("id") % 2).cast("int").alias("year"), F.lit("a,b").alias("text"))


def files_of(folder, product):
    return sorted(Path(folder.removeprefix("file://")).glob(f"product={product}/*/part-*"))


def test_rows_come_back_and_folders_are_pruned(spark, rows, tmp_path):
    root = f"file://{tmp_path}/a"
    folder = archive.publish(rows.repartition(2), root, ["product", "year"], "csv", rows_per_file=5)
    got = archive.current(spark, root)
    assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = got.filter("product = '1' AND year = 2021")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(product" in plan and "(product#" in plan
    assert one.count() == rows.filter("product = '1' AND year = 2021").count()
    manifest = spark.read.parquet(f"{folder}-manifest")
    assert manifest.count() == sum(len(files_of(folder, k)) for k in range(3)) and all(r["path"].startswith("product=") for r in manifest.collect())


def test_changed_missing_and_unlisted_files(spark, rows, tmp_path):
    root = f"file://{tmp_path}/a"
    folder = archive.publish(rows, root, ["product"], "csv")
    part = sorted(Path(folder.removeprefix("file://")).glob("product=0/part-*"))[0]
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    body = part.read_bytes()
    part.write_bytes(body.replace(b"2020", b"2021", 1))
    with pytest.raises(ValueError, match="changed: product=0/part-"):
        archive.current(spark, root)
    assert archive.current(spark, root, check=False).count() == 100
    part.write_bytes(body)
    assert archive.current(spark, root).count() == 100
    os.rename(part, f"{part}.csv")
    assert {(r["fault"]) for r in archive.faults(spark, folder).collect()} == {"missing", "unlisted"}


def test_a_generation_is_seen_whole_or_not_at_all(spark, rows, tmp_path):
    root = f"file://{tmp_path}/a"
    with pytest.raises(ValueError, match="nothing"):
        archive.current(spark, root)
    archive.publish(rows.filter("id < 10"), root)
    rows.write.parquet(f"{root}/generation-x")  # a writer that was lost before it could point here
    assert archive.current(spark, root).count() == 10
    archive.publish(rows.filter("id < 20"), root)
    assert archive.current(spark, root).count() == 20
    archive.publish(rows.limit(0), root)
    assert archive.current(spark, root).collect() == [] and archive.current(spark, root).columns == rows.columns
