"""Ingest: header-driven CSV to rows, validation into an accepted and a rejected stream, the idempotent archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions.geo import in_box


def poll_window_start(available_s: Column, day_range: int = 2) -> Column:
    """UTC midnight of the arrival, an hour of grace before it, less the days asked for beyond the first."""
    graced = available_s - p.GRACE_S
    return graced - graced % 86400 - (day_range - 1) * 86400


def violations(day_range: int = 2) -> Column:
    """The codes of all rules that a row breaks, in order; values are never clamped."""
    missing = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    rules = {
        "outside_bbox": ~in_box(F.col("lat"), F.col("lon"), p.BOX, p.BOX_SLACK),
        "future_acquisition": F.col("acq_s") > F.col("available_s") + p.SKEW_S,
        "before_window": F.col("acq_s") < poll_window_start(F.col("available_s"), day_range),
        "footprint": ~((missing("scan_km") > 0) & (missing("scan_km") <= p.FOOTPRINT_KM) & (missing("track_km") > 0) & (missing("track_km") <= p.FOOTPRINT_KM)),
        "negative_frp": F.col("frp") < 0,
        "brightness": ~F.col("brightness_k").between(*p.BRIGHTNESS_K),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))


def validated(rows: DataFrame, day_range: int = 2) -> DataFrame:
    """The rows with their violations: accepted ones have none, the rest is the dead-letter partition."""
    return rows.withColumn("violations", violations(day_range))


def append_new(rows: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the archive has not, the first of each key in a total order."""
    fresh = rows.join(archive.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return first.select(*keys, "_row.*").select(*rows.columns)


def footprint_km() -> tuple[Column, Column]:
    return F.coalesce("scan_km", F.lit(1.0)), F.coalesce("track_km", F.lit(2.0))


def link_distance_km() -> Column:
    """Fixed by source; for MODIS one and a half times the footprint's mean side, three kilometres at least."""
    out = F.lit(None).cast("double")
    for source, km in p.EPS_KM.items():
        out = F.when(F.col("source") == source, F.lit(km)).otherwise(out)
    scan, track = footprint_km()
    return F.when(F.col("source") == "modis", F.greatest(F.lit(3.0), 1.5 * F.sqrt(scan * track))).otherwise(out)
