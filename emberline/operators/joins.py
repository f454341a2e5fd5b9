"""Joins on places, times and sets.  Places meet in grid cells, so every join below is an equality join before it is exact."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions.geo import cell, cells_within, haversine_km, planar_km, quantize
from emberline.operators.graph import shared_checkpoints, written


def near_places(left: DataFrame, right: DataFrame, radius_km: Column, per_degree: int = p.ZONE_CELLS) -> DataFrame:
    """lat, lon, r_lat, r_lon, km_q (whole quanta): each place of the left with the right's within its largest radius.

    A place stands once, however many rows are there, and so does a pair of places.  The left's places are repeated for each
    cell that their disc may touch; what is repeated outgrows what its table's size promises, so nothing is broadcast.
    """
    a = left.groupBy("lat", "lon").agg(F.max(radius_km).alias("_radius"))
    a = a.withColumn("_cell", F.explode(cells_within(F.col("lat"), F.col("lon"), F.col("_radius"), per_degree)))
    b = right.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct().withColumn("_cell", cell(F.col("r_lat"), F.col("r_lon"), per_degree))
    km = quantize(planar_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return a.hint("merge").join(b, "_cell").withColumn("km_q", km).filter(F.col("km_q") <= quantize(F.col("_radius"))).drop("_cell", "_radius")


def _prefixed(right: DataFrame) -> DataFrame:
    return right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])


#: The most rows of one place in a list.
HELD = 256


def listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, held: the rows of each key as lists of HELD at most, for ``each_of``."""
    rest = [c for c in rows.columns if c not in keys]
    part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(rest[0])) - 1) / HELD)
    return rows.withColumn("_part", part).groupBy(*keys, "_part").agg(F.collect_list(F.struct(*rest)).alias("held")).drop("_part")


def each_of(at: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``at`` joined with rows by keys: what meets are lists, so pairs are made one by one where they are used, and no join sorts, buffers or reads them as rows."""
    return at.hint("merge").join(listed(rows, keys), keys).select(*at.columns, F.inline("held"))


def radius_join(left: DataFrame, right: DataFrame, radius_km: Column, per_degree: int = p.ZONE_CELLS) -> DataFrame:
    """Pairs within the left row's radius, with km_q (whole quanta).  Both sides have lat and lon; the right's are prefixed r_.

    Places meet first; rows then follow their places, so what is shuffled is rows by near places, not pairs of rows.
    """
    at = _prefixed(right).hint("merge").join(near_places(left, right, radius_km, per_degree), ["r_lat", "r_lon"])
    return each_of(at, left, ["lat", "lon"]).filter(F.col("km_q") <= quantize(radius_km))


def nearest(left: DataFrame, right: DataFrame, key: str, radius_km: float, per_degree: int = p.ZONE_CELLS, rank: Column | None = None) -> DataFrame:
    """The left's rows with a right row within the radius, and of these r_rank (least first), km_q and r_key of the first in that order.

    Of the right's rows at one place the first stands for all, and what is found for a place holds for all rows there.
    """
    best = right.groupBy("lat", "lon").agg(F.min(F.struct((F.lit(0) if rank is None else rank).alias("rank"), F.col(key).alias("key"))).alias("best"))
    pairs = near_places(left, right, F.lit(radius_km), per_degree).hint("merge").join(_prefixed(best), ["r_lat", "r_lon"])
    first = pairs.groupBy("lat", "lon").agg(F.min(F.struct(F.col("r_best.rank").alias("r_rank"), "km_q", F.col("r_best.key").alias("r_key"))).alias("_first"))
    return left.join(first, ["lat", "lon"]).select(*left.columns, "_first.*")


#: Kilometres within which the near is looked for after what is at the same place; then three times as far, and so on.
FIRST_KM = 0.12


def _reaches(radius_km: float) -> list[float]:
    reaches = [0.0, FIRST_KM]
    while reaches[-1] * 6 < radius_km:
        reaches.append(reaches[-1] * 3)
    return [*[km for km in reaches if km < radius_km], radius_km]


def _nearest_first(rows: DataFrame, others: DataFrame, radius_km: float, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``found`` finds for rows (lat, lon and more) among others (r_lat, r_lon and more) within the radius, those further away asked last.

    ``found`` gets rows with the others in reach and km_q, and returns the rows for which it has something, with it.  Who finds
    something within a reach looks no further, which is exact where the nearest counts, or any.  So pairs of places are
    made for the rows alone that near places leave, and each reach is kept as a table.
    """
    keys, at = rows.columns, others.select(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
    rest, kept = written(rows, "rest"), []
    for km in _reaches(radius_km):
        if km:
            places = near_places(rest, at, F.lit(km), min(p.ZONE_CELLS * 50, max(1, int(100 / km))))
            pairs = rest.hint("merge").join(places, ["lat", "lon"]).hint("merge").join(others, ["r_lat", "r_lon"])
        else:
            pairs = rest.hint("merge").join(others, (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon"))).withColumn("km_q", F.lit(0).cast("long"))
        kept.append(written(found(pairs), "found"))
        if km == radius_km:
            break
        rest = written(rest.join(kept[-1].select(*keys), keys, "left_anti"), "rest")
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, kept)


def reignitions(children: DataFrame, parents: DataFrame, window_s: Column, radius_km: float) -> DataFrame:
    """child, parent, gap_s, km_q: each child's parent, whose end it follows after the link time and within the window.

    Of several the nearest, then the earliest started, then the smallest id.  Rows of one place and time are one: of parents
    that end alike the first stands for all, and children that start alike have the same parent.  (No row is its own parent,
    as none starts after its end.)  Children that start too early to follow any end aren't looked up.
    """
    ends = parents.groupBy("lat", "lon", "last_s").agg(F.min(F.struct("started_s", "fire_id")).alias("first"))
    ends = written(ends.groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).agg(F.collect_list(F.struct("last_s", "first")).alias("_ends")), "ends")
    earliest = ends.agg(F.min(F.array_min("_ends.last_s")).alias("_earliest"))
    starts = children.select("lat", "lon", "started_s", window_s.alias("_window")).distinct().crossJoin(F.broadcast(earliest))
    starts = starts.filter(F.col("started_s") - F.col("_earliest") > p.T_LINK_H * 3600).drop("_earliest")
    gap = lambda e: F.col("started_s") - e["last_s"]
    held = F.filter("_ends", lambda e: (gap(e) > p.T_LINK_H * 3600) & (gap(e) <= F.col("_window")))
    first = F.array_min(F.transform(held, lambda e: F.struct(F.col("km_q").alias("km_q"), e["first"].alias("first"), gap(e).alias("gap_s"))))
    best = lambda pairs: pairs.select(*starts.columns, first.alias("_f")).filter("_f IS NOT NULL").groupBy(*starts.columns).agg(F.min("_f").alias("_f"))
    found = _nearest_first(starts, ends, radius_km, best)
    rows = children.withColumn("_window", window_s).join(found, starts.columns)
    return rows.select(F.col("fire_id").alias("child"), F.col("_f.first.fire_id").alias("parent"), F.col("_f.gap_s").alias("gap_s"), F.col("_f.km_q").alias("km_q"))


def followed(rows: DataFrame, radius_km: float, least_s: int, most_s: int) -> DataFrame:
    """The rows with another near that starts so many seconds after their end.  Rows of one place and time are looked up once, and those that end too late for any start not at all."""
    starts = written(rows.groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).agg(F.collect_set("started_s").alias("_starts")), "starts")
    latest = starts.agg(F.max(F.array_max("_starts")).alias("_latest"))
    ends = rows.select("lat", "lon", "last_s").distinct().crossJoin(F.broadcast(latest)).filter(F.col("_latest") - F.col("last_s") >= least_s).drop("_latest")
    held = F.exists("_starts", lambda s: s.between(F.col("last_s") + least_s, F.col("last_s") + most_s))
    found = _nearest_first(ends, starts, radius_km, lambda pairs: pairs.filter(held).select(*ends.columns).distinct())
    return rows.join(found, ["lat", "lon", "last_s"], "left_semi")


def near_pairs(points: DataFrame, key: str, label: str, km: float, seconds: int) -> DataFrame:
    """a, b of every two rows of different labels that lie close in place and time, each pair once.

    Place and time are cut into cells larger than the bounds.  Each row is in one cell and meets the cells that its reach
    touches, which are two or three of each kind of place, and two of time.
    """
    side, step = 20, 2 * seconds
    # a little over the reach, at the narrowest degree of longitude that counts (there are wider ones only south of it)
    north, east = km / p.KM_LAT * 1.001, km / 70 * 1.001
    cells = {"_r": F.floor(F.col("lat") * side).cast("long"), "_c": F.floor(F.col("lon") * side).cast("long"), "_t": F.floor(F.col("acq_s") / step).cast("long")}
    spread = {"_r": (F.col("lat"), north, 1 / side), "_c": (F.col("lon"), east, 1 / side), "_t": (F.col("acq_s"), seconds, step)}
    a = points.select(F.col(key).alias("a"), F.col(label).alias("la"), "lat", "lon", "acq_s")
    for c, (x, reach, size) in spread.items():
        a = a.withColumn(c, F.explode(F.sequence(F.floor((x - reach) / size).cast("long"), F.floor((x + reach) / size).cast("long"))))
    b = points.select(F.col(key).alias("b"), F.col(label).alias("lb"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("acq_s").alias("acq2_s"), *[v.alias(k) for k, v in cells.items()])
    close = quantize(planar_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))) <= quantize(F.lit(km))
    return a.hint("merge").join(b, ["_r", "_c", "_t"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.abs(F.col("acq_s") - F.col("acq2_s")) <= seconds) & close).select("a", "b")


def flash_context(events: DataFrame, flashes: DataFrame, km: float = 10.0, hours: int = 3) -> DataFrame:
    """Each event's flashes within reach before its start: count and the nearest in whole metres (null: none).

    Flashes of one place and second are one with their count; events that start alike at one place are looked up once.
    """
    bucket = lambda c: F.floor(c / (hours * 3600)).cast("long")
    e = events.select("started_s", "lat", "lon").distinct().withColumn("_cell", F.explode(cells_within(F.col("lat"), F.col("lon"), F.lit(km * 1.02), 10))).withColumn("_t", F.explode(F.sequence(bucket(F.col("started_s")) - 1, bucket(F.col("started_s")))))
    f = flashes.groupBy(F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "t_s").agg(F.count("*").alias("_n")).withColumns({"_cell": cell(F.col("f_lat"), F.col("f_lon"), 10), "_t": bucket(F.col("t_s"))})
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))
    hits = e.hint("merge").join(f, ["_cell", "_t"]).filter((F.col("t_s") >= F.col("started_s") - hours * 3600) & (F.col("t_s") <= F.col("started_s"))).withColumn("far", far).filter(F.col("far") <= km)
    found = hits.groupBy("started_s", "lat", "lon").agg(F.sum("_n").alias("flashes"), F.floor(F.min("far") * 1000 + 0.5).cast("long").alias("nearest_m"))
    return events.select("fire_id", "started_s", "lat", "lon").join(found, ["started_s", "lat", "lon"], "left").select("fire_id", F.coalesce("flashes", F.lit(0)).cast("long").alias("flashes"), "nearest_m")


def bracket(rows: DataFrame, series: DataFrame, key: str, at: str, step: str, value: str, longest: int) -> DataFrame:
    """value_q: the series' value at each row's time, between its last step at or before and first at or after; null beyond ``longest``.

    What is further apart than ``longest`` counts for nothing, so time is cut into buckets of that length, and steps and rows
    are merged in one ordering for each key and bucket, with the steps of the buckets before and after.
    """
    bucket = lambda c: F.floor(F.col(c) / longest).cast("long")
    series = series.withColumn("_k", F.explode(F.sequence(bucket(step) - 1, bucket(step) + 1)))
    both = rows.select(F.col(key), bucket(at).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_row"), F.struct(*rows.columns).alias("_own"), F.lit(None).cast("double").alias("_v")).unionByName(
        series.select(F.col(key), "_k", F.col(step).alias("_t"), F.lit(0).alias("_row"), F.lit(None).alias("_own"), F.col(value).cast("double").alias("_v")), allowMissingColumns=True)
    known = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    back = Window.partitionBy(key, "_k").orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "_k").orderBy(F.desc("_t"), F.col("_row")).rowsBetween(Window.unboundedPreceding, 0)
    b = both.withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.last(known, ignorenulls=True).over(ahead)}).filter("_row = 1")
    span = F.col("_b._t") - F.col("_a._t")
    blend = F.when(span == 0, F.col("_a._v")).otherwise(F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * (F.col("_t") - F.col("_a._t")) / span)
    return b.select("_own.*", F.when(span <= longest, F.floor(blend + 0.5).cast("long")).alias("value_q"))


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_key, r_key, common, united of sets (key, element rows) whose Jaccard similarity is at least ``least`` (over 0).

    Two such sets share one of the first |x| - ceil(least |x|) + 1 elements of each, rarest first, so sets meet in those
    alone, never in an element that many have; what meets is then counted whole.  Exact.  Sets are dealt by key once, which
    serves for what is told of a set as well as for its elements; short elements make for small shuffles.
    """
    left, right = left.repartition("key").distinct(), right.repartition("key").distinct()
    often = left.select("element").unionAll(right.select("element")).groupBy("element").agg(F.count("*").alias("_f"))
    sized = lambda df: df.withColumn("_n", F.count("*").over(Window.partitionBy("key")))

    def firsts(df: DataFrame, side: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("key").orderBy("_f", "element"))
        rows = sized(df).join(often, "element").withColumn("_p", place).filter(F.col("_p") <= F.col("_n") - F.ceil(least * F.col("_n") - 1e-9) + 1)
        return rows.select("element", F.col("key").alias(f"{side}_key"), F.col("_n").alias(f"n_{side}"))

    met = firsts(left, "l").join(firsts(right, "r"), "element").filter((F.col("n_l") >= least * F.col("n_r") - 1e-9) & (F.col("n_r") >= least * F.col("n_l") - 1e-9)).drop("element").distinct()
    common = met.join(left.select(F.col("key").alias("l_key"), "element"), "l_key").join(right.select(F.col("key").alias("r_key"), "element"), ["r_key", "element"])
    out = common.groupBy("l_key", "r_key", "n_l", "n_r").agg(F.count("*").alias("common")).withColumn("united", F.col("n_l") + F.col("n_r") - F.col("common"))
    return out.filter(F.col("common") >= least * F.col("united")).select("l_key", "r_key", "common", "united")


def mutual_matches(pairs: DataFrame, order: list[Column], right: list[Column] | None = None) -> DataFrame:
    """Greedy one-to-one matching: pairs that are the first of both their sides are claimed, round after round.

    ``right``: another order by which the right side chooses; then the matching is the stable one.  If the right side
    ranks the left rows alike everywhere, that is what the left rows get that choose in turn.

    The same pairs as claiming one at a time in a total order, since a pair that is first on both sides is claimed
    whatever else is.  Each round is kept as tables and claims at least one pair; the last leaves none.
    """
    ends = [F.col("l_key"), F.col("r_key")]  # make the orders total, as each pair stands once
    orders = {"r_key": [*(right or order), *ends]}
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(*orders.get(k[-1] if len(k) == 1 else "", [*order, *ends])))
    once = pairs.filter("l_key IS NOT NULL AND r_key IS NOT NULL").withColumn("_n", first("l_key", "r_key")).filter("_n = 1").drop("_n")
    rest, claimed, rounds = written(once, "pairs"), None, 0
    while True:
        now = rest.withColumns({"_l": first("l_key"), "_r": first("r_key")}).filter("_l = 1 AND _r = 1").drop("_l", "_r")
        now = written(now, "claimed")
        if now.isEmpty():
            break
        claimed, rounds = now if claimed is None else claimed.unionByName(now), rounds + 1
        if rounds % 20 == 0:
            claimed = written(claimed, "claimed")  # so that the plan doesn't grow with the rounds
        rest = rest.join(now.select("l_key"), "l_key", "left_anti").join(now.select("r_key"), "r_key", "left_anti").select(*pairs.columns)
        rest = written(rest, "pairs")
    return claimed if claimed is not None else pairs.limit(0)


def parity(reference: DataFrame, ours: DataFrame, key: str, group: str) -> DataFrame:
    """For each group: matched, missing (ours lacks it) and extra rows by key, and the verdict."""
    both = reference.select(group, key, F.lit(1).alias("theirs")).distinct().join(ours.select(group, key, F.lit(1).alias("own")).distinct(), [group, key], "full_outer")
    out = both.groupBy(group).agg(F.count_if(F.col("theirs").isNotNull() & F.col("own").isNotNull()).alias("matched"), F.count_if(F.col("own").isNull()).alias("missing"), F.count_if(F.col("theirs").isNull()).alias("extra"))
    return out.withColumn("verdict", F.when(F.col("missing") > 0, "deficit").otherwise("parity"))


def closure(links: DataFrame, child: str, parent: str) -> DataFrame:
    """alias, canonical of every link: the end of its chain.  Pointers jump to their pointer's pointer, so rounds are few; a cycle is an error."""
    shared_checkpoints(links.sparkSession)
    at = links.filter(F.col(parent).isNotNull()).select(F.col(child).alias("alias"), F.col(parent).alias("canonical")).checkpoint()
    for _ in range(64):
        further = at.select(F.col("alias").alias("canonical"), F.col("canonical").alias("_next"))
        step = at.join(further, "canonical", "left").select("alias", F.coalesce("_next", "canonical").alias("canonical"), F.col("_next").isNotNull().alias("moved")).checkpoint()
        if not step.filter("alias = canonical").isEmpty():
            raise ValueError("the links have a cycle")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at
    raise ValueError("the links have a cycle")


def chains(links: DataFrame, child: str, parent: str, most: int) -> DataFrame:
    """alias, survivor, depth: every row's child itself (depth 0) and what it reaches in so many steps, up to ``most``.

    Each step is a join of what the last one reached, kept, so that rows are bounded by nothing but storage.
    """
    shared_checkpoints(links.sparkSession)
    further = links.filter(F.col(parent).isNotNull()).select(F.col(child).alias("survivor"), F.col(parent).alias("_next"))
    at = links.select(F.col(child).alias("alias"), F.col(child).alias("survivor"), F.lit(0).alias("depth"))
    out = at
    for depth in range(1, most + 1):
        at = at.join(further, "survivor").select("alias", F.col("_next").alias("survivor"), F.lit(depth).alias("depth")).checkpoint()
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out
