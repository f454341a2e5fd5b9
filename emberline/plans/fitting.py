"""Parameter grids over the driver's tables, and what is chosen from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import plateau
from emberline.plans.catalog import query, spark_sql

#: Orders by priority (slices) and by three parameters: year, quarter and a third of customers; how many there are, and which share is dear.
_SCORES = """
SELECT o_orderpriority AS slice, CAST(year(o_orderdate) - 1992 AS INT) AS i, CAST(quarter(o_orderdate) - 1 AS INT) AS j, CAST(o_custkey % 3 AS INT) AS k,
       count(*) AS events, CASE WHEN count(*) >= 4 THEN CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) END AS f1
FROM {orders} WHERE year(o_orderdate) BETWEEN 1992 AND 1998 GROUP BY 1, 2, 3, 4"""
EVENTS, F1, LEAST = 0.75, 0.45, 0.1


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark_sql(spark, sf_dir, _SCORES)
    return cells.select("slice", F.array("i", "j", "k").alias("index"), "events", "f1", (F.coalesce(F.col("f1"), F.lit(0.0)) >= LEAST).alias("meets"))


_STEP = "abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1"


@query("udf_10_plateaus", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT *, slice || '@' || i || ',' || j || ',' || k AS name FROM ({_SCORES}) t),
broke AS (SELECT DISTINCT a.name FROM c a JOIN c b ON a.slice = b.slice AND {_STEP} WHERE abs(b.events - a.events) > {EVENTS} * a.events + 1e-9 OR a.f1 IS NULL OR b.f1 IS NULL OR abs(a.f1 - b.f1) > {F1} + 1e-9),
ok AS MATERIALIZED (SELECT * FROM c WHERE f1 >= {LEAST} AND name NOT IN (SELECT name FROM broke)),
boxes AS (SELECT a.name, r.r, count(*) AS n FROM ok a CROSS JOIN range(0, 5) r(r) JOIN ok b ON a.slice = b.slice AND abs(a.i - b.i) <= r.r AND abs(a.j - b.j) <= r.r AND abs(a.k - b.k) <= r.r GROUP BY a.name, r.r),
deep AS (SELECT name, max(r) AS inradius FROM boxes WHERE n = pow(2 * r + 1, 3) GROUP BY name),
reach(name, root) AS (SELECT name, name FROM ok UNION SELECT b.name, reach.root FROM reach JOIN ok a ON a.name = reach.name JOIN ok b ON a.slice = b.slice AND {_STEP}),
m AS (SELECT ok.*, d.inradius, g.root FROM ok JOIN deep d ON d.name = ok.name JOIN (SELECT name, min(root) AS root FROM reach GROUP BY name) g ON g.name = ok.name),
w AS (SELECT root, any_value(slice) AS slice, count(*) AS cells, max(inradius) AS width, min([i, j, k]) AS least, sum(i) AS si, sum(j) AS sj, sum(k) AS sk FROM m GROUP BY root),
near AS (SELECT m.root, m.i, m.j, m.k, row_number() OVER (PARTITION BY m.root ORDER BY pow(w.cells * m.i - w.si, 2) + pow(w.cells * m.j - w.sj, 2) + pow(w.cells * m.k - w.sk, 2), m.i, m.j, m.k) AS place FROM m JOIN w ON w.root = m.root AND m.inradius = w.width)
SELECT CAST(row_number() OVER (ORDER BY w.width DESC, w.cells DESC, w.slice, w.least) AS INT) AS place, w.slice, w.cells, CAST(w.width AS INT) AS width, n.i || ',' || n.j || ',' || n.k AS centre FROM w JOIN near n ON n.root = w.root AND n.place = 1""")
def plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a grid of orders, widest first, and the middle of each."""
    found = plateau.plateaus(scores(spark, sf_dir), 3, EVENTS, F1)
    return found.withColumn("centre", F.array_join(F.col("centre").cast("array<string>"), ","))
