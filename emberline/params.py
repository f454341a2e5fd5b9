"""Constants of the domain, in one place.  Fixed values."""

#: Planar metric: kilometres for a degree of latitude, and of longitude at the reference latitude with its slope.
REF_LAT, KM_LAT, KM_LON, KM_LON_SLOPE = 42.7, 111.085, 81.936, -1.3146
#: Comparisons of distances are made in whole micro-kilometres.
KM_QUANTUM = 1e-6
#: Link distance by source; coarse sources only attach.
EPS_KM = {"viirs_noaa20": 1.25, "viirs_snpp": 1.25, "viirs_noaa21": 1.25, "modis": 3.0, "slstr": 1.5, "geo_msg": 5.5}
ATTACH_ONLY = ["geo_msg"]
T_LINK_H, ACTIVE_H, OVERPASS_CAP, GEO_BUCKET_H = 48, 72, 3, 3
#: Score weights and shape.
WEIGHTS = {"intercept": -2.0, "best": 1.8, "persist": 1.0, "multisource": 0.8, "night": 0.7, "coherence": 0.6, "frp": 0.5, "edge": -0.6, "glint": -0.8}
PRIORS = {("viirs", "high"): (0.9, 0.95), ("viirs", "nominal"): (0.65, 0.8), ("viirs", "low"): (0.25, 0.4), ("modis", "high"): (0.85, 0.9), ("modis", "nominal"): (0.55, 0.7), ("modis", "low"): (0.25, 0.35), ("geo", "any"): (0.55, 0.65), ("slstr", "any"): (0.6, 0.7)}
COHERENT_KM, FRP_SATURATION, CONFIRMED, LIKELY = 0.75, 100.0, 0.75, 0.45
#: Ingest rules: box (W, S, E, N) with its slack in degrees, clock skew, grace, footprint and brightness limits.
BOX, BOX_SLACK = (20.0, 39.0, 31.0, 46.0), 0.01
SKEW_S, GRACE_S, FOOTPRINT_KM, BRIGHTNESS_K = 300, 3600, 10.0, (150.0, 600.0)
#: Batch size breaker.
BREAKER = {"ratio": 10, "min_batch": 500, "min_samples": 12, "window": 24}
#: Zone grid cells for a degree; coarsening cells for a degree.
ZONE_CELLS, COARSE_CELLS = 20, 100
EARTH_KM = 6371.0088
#: Miss weights in millionths, (day, night) for each family of sources; geostationary slots have a weight, a length, a
#: daily cap, and count only for fires of that brightness.
EVIDENCE_QUANTUM = 1_000_000
MISS_WEIGHTS = {"viirs": (1_000_000, 1_250_000), "modis": (500_000, 500_000), "slstr": (750_000, 750_000)}
GEO_SLOT_S, GEO_SLOT_Q, GEO_CAP_Q, GEO_LEAST_MW = 600, 50_000, 1_000_000, 45.0
#: Cloud cover in per cent: above the first nothing is seen, from the second on half.
CLOUD_BLOCKS, CLOUD_HALVES = 80, 50
#: Evidence (millionths) that closes an event, ordinary and large; hours and days of the rules of closing and display.
CLOSE_Q, CLOSE_LARGE_Q, QUIET_H, BLIND_DAYS, MAP_H, FEED_H = 3_000_000, 5_000_000, 24, 14, 48, 168
LARGE_HA, LARGE_MW = 100, 100
