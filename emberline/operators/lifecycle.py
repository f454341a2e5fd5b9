"""The lifecycle of events: evidence that nothing saw them any more, and the state that follows from it.

Times are whole seconds and evidence whole millionths.  What the sky let satellites see is worked out once for each region and
for each of its moments that an event may have been seen last at, and written as a table.  Events fetch theirs from these,
which are far fewer, so that events themselves are neither repeated by pass or day nor gathered again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators.graph import written

DAY, HOUR = 86_400, 3_600
#: What a tick hands to the next, for each event.
CARRY = "event_id long, state string, e_q long, geo_day_s long, geo_q long, blind_since_s long, inactive_since_s long, declared_s long, last_s long"
#: Verdicts on passes that were no chance to see the event.
NO_CHANCE = ["cloud_blocked", "source_frozen"]


def _floor_to(x: Column, step: int) -> Column:
    return (F.floor(x / step) * step).cast("long")


def banded(looks: DataFrame, cloud: DataFrame, outages: DataFrame) -> DataFrame:
    """Looks (region, source, at_s) with their band: frozen, blocked, half or clear.

    cloud: region, hour_s, percent; of several values for an hour the highest counts, and an hour without one is blocked.
    outages: source, from_s, to_s (null: not over yet), half open.
    """
    hours = cloud.groupBy("region", "hour_s").agg(F.max("percent").alias("percent"))
    within = (F.col("l.source") == F.col("o.source")) & (F.col("l.at_s") >= F.col("o.from_s")) & (F.col("o.to_s").isNull() | (F.col("l.at_s") < F.col("o.to_s")))
    frozen = looks.select("source", "at_s").distinct().alias("l").join(outages.alias("o"), within, "left_semi").withColumn("frozen", F.lit(True))
    rows = looks.withColumn("hour_s", _floor_to(F.col("at_s"), HOUR)).join(hours, ["region", "hour_s"], "left").join(frozen, ["source", "at_s"], "left")
    band = F.when(F.col("frozen"), "frozen").when(F.col("percent").isNull() | (F.col("percent") > p.CLOUD_BLOCKS), "blocked").when(F.col("percent") >= p.CLOUD_HALVES, "half").otherwise("clear")
    return rows.select(*looks.columns, band.alias("band"))


def miss_weight(source: Column, phase: Column) -> Column:
    """Millionths that a missed pass weighs; null for sources without passes."""
    out = F.lit(None).cast("long")
    for family, (day, night) in p.MISS_WEIGHTS.items():
        out = F.when(source.startswith(family), F.when(phase == "day", F.lit(day)).otherwise(F.lit(night)).cast("long")).otherwise(out)
    return out


#: A moment before all passes.
_NEVER = -(2**62)


def _missed() -> Column:
    """The verdict on a banded pass that did not see the event."""
    return F.when(F.col("band") == "frozen", "source_frozen").when(F.col("band") == "blocked", "cloud_blocked").when(F.col("band") == "half", "half_weight").otherwise("counted")


def _weight_q() -> Column:
    """What a pass of a verdict weighs."""
    weight = miss_weight(F.col("source"), F.col("phase"))
    return F.when(F.col("verdict") == "counted", weight).when(F.col("verdict") == "half_weight", F.floor(weight / 2)).otherwise(0).cast("long")


def pass_verdicts(events: DataFrame, passes: DataFrame) -> DataFrame:
    """event_id, source, at_s, phase, verdict, weight_q of each banded pass over each event (event_id, region, last_s)."""
    seen = events.select("event_id", "region", "last_s").join(passes, "region").withColumn("verdict", F.when(F.col("at_s") <= F.col("last_s"), "detected").otherwise(_missed()))
    return seen.select("event_id", "source", "at_s", "phase", "verdict", _weight_q().alias("weight_q"))


def passes_after(looks: DataFrame) -> DataFrame:
    """region, after: for each moment at_s of a banded pass, and for one before all, what an event last seen then has for evidence.

    In order of time: at_s, polar_q, day_miss, night_miss, polar_chances, polar_chance_s.
    """
    rows = looks.withColumn("verdict", _missed()).select("region", "at_s", F.lit(1).alias("one"), "phase", (~F.col("verdict").isin(NO_CHANCE)).alias("counted"), _weight_q().alias("weight_q"))
    first = looks.select("region", F.lit(_NEVER).alias("at_s")).distinct()
    order = Window.partitionBy("region").orderBy("at_s")
    rest, past = order.rangeBetween(1, Window.unboundedFollowing), order.rangeBetween(Window.unboundedPreceding, 0)
    miss = lambda phase: F.coalesce(F.max((F.col("weight_q") > 0) & (F.col("phase") == phase)).over(rest), F.lit(False)).alias(f"{phase}_miss")
    seen = rows.unionByName(first, allowMissingColumns=True).select("region", "at_s", F.sum("weight_q").over(rest).alias("polar_q"), miss("day"), miss("night"),
        (F.count("one").over(past) + F.count_if("counted").over(rest)).alias("polar_chances"), F.coalesce(F.max(F.when(F.col("counted"), F.col("at_s"))).over(rest), F.when(F.col("at_s") > _NEVER, F.col("at_s"))).alias("polar_chance_s"))
    return seen.groupBy("region").agg(F.sort_array(F.collect_set(F.struct("at_s", "polar_q", "day_miss", "night_miss", "polar_chances", "polar_chance_s"))).alias("after"))  # a window's passes over one region


def slot_days(regions: DataFrame, cloud: DataFrame, outages: DataFrame, from_s: int, to_s: int) -> DataFrame:
    """region, day_s, slots: the geostationary slots that start in the window, as one ordered array a day."""
    first = -(-from_s // p.GEO_SLOT_S) * p.GEO_SLOT_S
    if first >= to_s:
        return regions.limit(0).select("region", F.lit(0).cast("long").alias("day_s"), F.array().cast("array<struct<at_s: long, source: string, band: string>>").alias("slots"))
    grid = regions.select("region", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(to_s - 1).cast("long"), F.lit(p.GEO_SLOT_S).cast("long"))).alias("at_s")).withColumn("source", F.explode(F.array(*map(F.lit, p.ATTACH_ONLY))))
    rows = banded(grid, cloud, outages)
    return rows.groupBy("region", _floor_to(F.col("at_s"), DAY).alias("day_s")).agg(F.array_sort(F.collect_list(F.struct("at_s", "source", "band"))).alias("slots"))  # a day of one region


def _spent(slots: Column, already: Column, bright: Column, last_s: Column) -> Column:
    """used, taken, chances, chance_s after a day's slots: the cap refuses whole slots, it never cuts one."""
    none = F.lit(None).cast("long")

    def step(acc: Column, slot: Column) -> Column:
        weight = F.when(slot["band"] == "clear", p.GEO_SLOT_Q).when(slot["band"] == "half", p.GEO_SLOT_Q // 2).cast("long")
        detected = bright & (slot["at_s"] <= last_s)
        takes = bright & ~detected & F.coalesce(acc["used"] + weight <= p.GEO_CAP_Q, F.lit(False))
        chance = detected | takes
        return F.struct(
            (acc["used"] + F.when(takes, weight).otherwise(0)).alias("used"), (acc["taken"] + takes.cast("long")).alias("taken"),
            (acc["chances"] + chance.cast("long")).alias("chances"), F.when(chance, slot["at_s"]).otherwise(acc["chance_s"]).alias("chance_s"),
        )

    start = F.struct(already.alias("used"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("chances"), none.alias("chance_s"))
    return F.aggregate(slots, start, step)


def blind_days(chance_s: Column, since_s: Column, to_s: int) -> Column:
    """Whole UTC days up to the window's end, from the run's start on, after the last chance; none if that lies in the part day at the end."""
    first, last = F.ceil(since_s / DAY).cast("long") * DAY, (to_s - DAY) // DAY * DAY
    seen = F.greatest(F.coalesce(_floor_to(chance_s, DAY), first - DAY), first - DAY)
    days = ((F.lit(last) - seen) / DAY).cast("long")
    return F.when((F.lit(last) < first) | (chance_s >= last + DAY), 0).otherwise(days).cast("long")


def miss_evidence(events: DataFrame, passes: DataFrame, cloud: DataFrame, outages: DataFrame, from_s: int, to_s: int) -> DataFrame:
    """Events with added_q, e_q, day_miss, night_miss, chances, blind_days, blind_since_s, geo_day_s, geo_q of the window [from_s, to_s).

    events: event_id, region, last_s, last_frp, and from earlier windows e_q, geo_day_s, geo_q, blind_since_s.
    passes: region, source, at_s, phase of overpasses.
    """
    events = written(events, "standing")
    looks = banded(passes.filter((F.col("at_s") >= from_s) & (F.col("at_s") < to_s)), cloud, outages)
    polar = written(passes_after(looks), "polar")

    end_day, first_day = (max(to_s - 1, from_s)) // DAY * DAY, from_s // DAY * DAY
    bright = F.coalesce(F.col("last_frp") >= p.GEO_LEAST_MW, F.lit(False))
    # Slots count for bright events alone, and then by the last slot seen and the balance of a day of the window: events alike in these are one case.
    spends = F.coalesce(F.col("geo_day_s").between(first_day, end_day), F.lit(False))
    slot = F.least(F.greatest(_floor_to(F.col("last_s"), p.GEO_SLOT_S), F.lit(first_day - p.GEO_SLOT_S)), F.lit(end_day + DAY))
    events = events.withColumns({"_bright": bright, "_slot": slot, "_day": F.when(spends, F.col("geo_day_s")), "_held": F.when(spends, F.col("geo_q"))})
    of = ["region", "_slot", "_day", "_held"]
    days = slot_days(events.select("region").distinct(), cloud, outages, from_s, to_s)
    already = F.when(F.col("_day") == F.col("day_s"), F.col("_held")).otherwise(0).cast("long")
    # Of a case, a day's slots depend on the balance and on the last slot seen in it: each distinct one is folded once.
    seen = F.least(F.greatest(F.col("_slot"), F.col("day_s") - p.GEO_SLOT_S), F.col("day_s") + DAY)
    own = events.filter("_bright").select(*of).distinct().join(days.select("region", "day_s"), "region").select(*of, "day_s", already.alias("already"), seen.alias("seen"))
    case = ["region", "day_s", "already", "seen"]
    cases = own.select(*case).distinct().join(days, ["region", "day_s"]).select(*case, _spent(F.col("slots"), F.col("already"), F.lit(True), F.col("seen")).alias("s"))
    geo = own.join(cases, case).groupBy(*of).agg(
        F.sum(F.col("s.used") - F.col("already")).alias("added"), F.sum("s.chances").alias("geo_chances"), F.max("s.chance_s").alias("geo_chance_s"),
        F.max(F.when((F.col("day_s") == end_day) & (F.col("s.taken") > 0), F.col("s.used"))).alias("spent"))
    geo = written(geo, "geo")

    kept = events.withColumnsRenamed({"e_q": "was_q", "geo_day_s": "was_day_s", "geo_q": "was_spent_q", "blind_since_s": "was_blind_s"})
    after = F.array_max(F.filter("after", lambda x: x["at_s"] <= F.coalesce("last_s", F.lit(_NEVER))))
    kept = kept.join(polar, "region", "left").withColumn("_after", after).select(*kept.columns, "_after.*").drop("at_s")
    alike = [kept["_bright"], kept["region"] == geo["region"], *[kept[c].eqNullSafe(geo[c]) for c in of[1:]]]
    rows = kept.join(geo, reduce(Column.__and__, alike), "left").drop(*[geo[c] for c in of])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    chance, since = F.greatest("polar_chance_s", "geo_chance_s"), F.coalesce("was_blind_s", F.lit(from_s).cast("long"))
    balance = F.coalesce("spent", F.when(F.col("was_day_s") == end_day, F.col("was_spent_q")))
    rows = rows.withColumns({
        "added_q": zero(F.col("polar_q")) + zero(F.col("added")), "chances": zero(F.col("polar_chances")) + zero(F.col("geo_chances")), "blind_days": blind_days(chance, since, to_s),
        "blind_since_s": F.coalesce(_floor_to(chance, DAY) + DAY, since), "geo_q": balance, "geo_day_s": F.when(balance.isNotNull(), F.lit(end_day)).cast("long"),
        "day_miss": F.coalesce("day_miss", F.lit(False)), "night_miss": F.coalesce("night_miss", F.lit(False)),
    })
    rows = rows.withColumn("e_q", zero(F.col("was_q")) + F.col("added_q"))
    own = [c for c in events.columns if c not in ("e_q", "geo_day_s", "geo_q", "blind_since_s") and not c.startswith("_")]
    return rows.select(*own, "added_q", "e_q", "day_miss", "night_miss", "chances", "blind_days", "blind_since_s", "geo_day_s", "geo_q")


def is_large(area_ha: Column, max_frp: Column, peat: Column) -> Column:
    """By area, by brightness, or on peat; what isn't known is not large."""
    return F.coalesce(area_ha >= p.LARGE_HA, F.lit(False)) | F.coalesce(max_frp >= p.LARGE_MW, F.lit(False)) | F.coalesce(peat, F.lit(False))


def display_tier(state: Column, inactive_s: Column) -> Column:
    """Where an event shows, by the time since it left the detected states: map, feed, archive."""
    aged = F.when(inactive_s >= p.FEED_H * HOUR, "archive").when(inactive_s >= p.MAP_H * HOUR, "feed").otherwise("map")
    return F.when(state == "archived", "archive").when(state.isin("active", "signal_weakening"), "map").otherwise(aged)


def decided(events: DataFrame, at_s: int) -> DataFrame:
    """event_id, from_state, state, reason, tier, excluded, inactive_since_s: the rules in order of authority.

    events: event_id, state, last_s, redetected_s (null: none), e_q, large, day_miss, night_miss, chances, blind_days,
    inactive_since_s.  A detection outranks what is inferred; a curated state is nobody's to move, it only ages; evidence
    is tried before blindness, since closures by blindness are excluded from quality counts.
    """
    state, redetected = F.col("state"), F.col("redetected_s")
    curated, held = state.startswith("officially_"), F.coalesce("inactive_since_s", F.lit(at_s).cast("long"))
    aged = display_tier(F.lit("no_longer_detected"), F.lit(at_s) - held)
    close_q = F.when(F.col("large"), p.CLOSE_LARGE_Q).otherwise(p.CLOSE_Q)
    idle = F.lit(at_s) - F.col("last_s")
    missed = (F.col("e_q") >= close_q) & (idle >= p.QUIET_H * HOUR) & F.col("day_miss") & F.col("night_miss")
    blind = (F.col("blind_days") >= p.BLIND_DAYS) & (idle >= p.BLIND_DAYS * DAY)
    linked = redetected - F.col("last_s") <= p.T_LINK_H * HOUR
    to = lambda name, reason, excluded=False: F.struct(name.alias("state"), reason.alias("reason"), F.lit(excluded).alias("excluded"))
    say = F.lit
    shown = F.when(aged == "map", "no_change").otherwise("display_window")
    outcome = (
        F.when(redetected.isNotNull() & linked, to(say("active"), say("redetection"))).when(redetected.isNotNull(), to(state, say("no_change")))
        .when(curated, to(state, shown)).when(state == "archived", to(state, say("no_change")))
        .when(state == "no_longer_detected", to(F.when(aged == "archive", "archived").otherwise(state), shown))
        .when(missed, to(say("no_longer_detected"), say("miss_evidence"))).when(blind, to(say("no_longer_detected"), say("unobservable"), True))
        .otherwise(to(F.when(F.col("e_q") * 2 >= close_q, "signal_weakening").otherwise("active"), F.when(F.col("chances") == 0, "no_opportunity").otherwise("insufficient_evidence")))
    )
    rows = events.withColumn("_to", outcome)
    since = F.when(~F.col("_to.state").isin("active", "signal_weakening"), held)
    rows = rows.withColumn("_since", since)
    own = [c for c in events.columns if c not in ("state", "inactive_since_s")]
    return rows.select(*own, F.col("state").alias("from_state"), "_to.state", "_to.reason", "_to.excluded", display_tier(F.col("_to.state"), F.lit(at_s) - F.col("_since")).alias("tier"), F.col("_since").alias("inactive_since_s"))


def tick(events: DataFrame, carry: DataFrame, declarations: DataFrame, passes: DataFrame, cloud: DataFrame, outages: DataFrame, since_s: int, at_s: int) -> DataFrame:
    """The decisions of one re-evaluation of all events over the window [since_s, at_s), with what ``carried`` takes from them.

    events: event_id, region, newest_s, last_frp, max_frp.  declarations: event_id, declared_s, declared_state,
    attribution.  An event is judged as it stood before what arrived since; a redetection voids the evidence.
    """
    standing = declarations.filter(F.col("declared_s") <= at_s).groupBy("event_id").agg(F.max(F.struct("declared_s", "declared_state", "attribution")).alias("d"))
    standing = standing.select("event_id", F.col("d.declared_s").alias("now_s"), F.col("d.declared_state").alias("now_state"))
    rows = events.join(carry, "event_id", "left").join(standing, "event_id", "left")
    arrived = F.col("last_s").isNull() | (F.col("newest_s") > F.col("last_s"))
    newer = F.col("now_s").isNotNull() & (F.col("declared_s").isNull() | (F.col("now_s") > F.col("declared_s")))
    rows = rows.select(
        "event_id", "region", "newest_s", "last_frp", "max_frp", F.coalesce("e_q", F.lit(0)).alias("e_q"), "geo_day_s", "geo_q", "blind_since_s", "inactive_since_s",
        F.when(newer, F.col("now_state")).otherwise(F.coalesce("state", F.lit("active"))).alias("state"), F.coalesce("now_s", "declared_s").alias("declared_s"),
        F.when(arrived, F.coalesce("last_s", "newest_s")).otherwise(F.col("newest_s")).alias("last_s"), F.when(arrived, F.col("newest_s")).alias("redetected_s"),
        is_large(F.lit(None).cast("double"), F.col("max_frp"), F.lit(False)).alias("large"))
    return decided(miss_evidence(rows, passes, cloud, outages, since_s, at_s), at_s)


def carried(found: DataFrame, carry: DataFrame) -> DataFrame:
    """What the next tick is given: the outcome of a tick, and carried events that the tick was not given, as they were."""
    evidence = F.when(F.col("reason") == "redetection", 0).otherwise(F.col("e_q")).cast("long")
    own = found.select("event_id", "state", evidence.alias("e_q"), "geo_day_s", "geo_q", "blind_since_s", "inactive_since_s", "declared_s", F.col("newest_s").alias("last_s"))
    return own.unionByName(carry.join(own.select("event_id"), "event_id", "left_anti"))
