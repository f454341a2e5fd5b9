"""Column functions for text, times, hashes and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_acq_iso(acq_date: Column, acq_time: Column) -> Column:
    """'YYYY-MM-DDTHH:MM:00Z' of a date and a time of one to four digits; null if out of range."""
    hhmm = F.lpad(acq_time.cast("string"), 4, "0")
    ok = acq_time.cast("string").rlike(r"^\d{1,4}$") & (F.substring(hhmm, 1, 2) < "24") & (F.substring(hhmm, 3, 2) < "60") & acq_date.cast("string").rlike(r"^\d{4}-\d\d-\d\d$")
    return F.when(ok, F.concat(acq_date.cast("string"), F.lit("T"), F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2), F.lit(":00Z")))


def canonical_degrees(raw: Column) -> Column:
    """Five decimals, halves away from zero, never '-0.00000'; null if it is no plain decimal."""
    text = F.when(raw.cast("string").rlike(r"^[+-]?\d{1,3}(\.\d+)?$"), raw.cast("string"))
    five = F.round(text.cast("decimal(38,20)"), 5).cast("decimal(10,5)").cast("string")
    return F.when(five == "-0.00000", "0.00000").otherwise(five)


def detection_uid(source: Column, acq_iso: Column, lat: Column, lon: Column) -> Column:
    """SHA-256 of source|time|lat|lon."""
    return F.sha2(F.concat_ws("|", source, acq_iso, lat, lon), 256)


def iso_week(day: Column) -> Column:
    """'YYYY-Www' by ISO 8601: the year of the week's Thursday."""
    thursday = F.date_add(day, 3 - F.weekday(day))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def minute_of_day(hhmm: Column) -> Column:
    parts = F.split(hhmm, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def in_quiet_hours(ts: Column, zone: Column, start: Column, end: Column) -> Column:
    """Local time of day within [start, end), which may pass midnight; an equal start and end is never quiet."""
    local = F.from_utc_timestamp(ts, zone)
    now = F.hour(local) * 60 + F.minute(local)
    a, b = minute_of_day(start), minute_of_day(end)
    return F.when(a == b, False).when(a < b, (now >= a) & (now < b)).otherwise((now >= a) | (now < b))


def window_start(ts: Column, zone: Column, hhmm: Column) -> Column:
    """The last instant at or before ts when local clocks showed hh:mm."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.date_trunc("day", local)
    at = lambda back: F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(day) - back * 86400 + minute_of_day(hhmm) * 60), zone)
    return F.when(at(0) <= ts, at(0)).otherwise(at(1))


#: What free text may not carry, and what stands in its place.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[jwt]"),
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9+/=._~-]{8,}", "$1 [credential]"),
    (r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b", "[bot-token]"),
]


def redact(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), REDACTIONS, text)


def xml_escape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], text)


def xml_unescape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")], text)


def label_escape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")], text)


def csv_cell(text: Column) -> Column:
    """A formula is disarmed with a quote; commas, quotes and line ends make a cell quoted."""
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(F.coalesce(text, F.lit("")))
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def wkt_point(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of 'POINT(x y)', null if it is none."""
    pattern = r"^\s*POINT\s*\(\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*\)\s*$"
    x, y = (F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i)).try_cast("double") for i in (1, 2))
    ok = x.between(-180, 180) & y.between(-90, 90)
    return F.when(ok, x), F.when(ok, y)


def wkt_box(text: Column) -> Column:
    """west, south, east, north of a POLYGON or MULTIPOLYGON, outward at four decimals; null if a vertex is malformed or out of range."""
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)"), 1), F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)"), 2)
    x, y = (F.transform(n, lambda v: v.cast("double")) for n in numbers)
    shape = text.rlike(r"^\s*(MULTI)?POLYGON\s*\([\s(]*(-?\d+(\.\d+)?\s+-?\d+(\.\d+)?[\s,()]*)+\)\s*$")
    ok = shape & (F.array_min(x) >= -180) & (F.array_max(x) <= 180) & (F.array_min(y) >= -90) & (F.array_max(y) <= 90)
    down, up = (lambda v: F.floor(v * 10000) / 10000), (lambda v: F.ceil(v * 10000) / 10000)
    return F.when(ok, F.struct(down(F.array_min(x)).alias("west"), down(F.array_min(y)).alias("south"), up(F.array_max(x)).alias("east"), up(F.array_max(y)).alias("north")))


#: Cyrillic letters and their Latin spelling.
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya"}


def transliterate(text: Column) -> Column:
    """Latin spelling of lower-case Cyrillic; a word's final 'ия' becomes 'ia'."""
    out = F.regexp_replace(text, r"ия(?!\p{L})", "ia")
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), [(k, v) for k, v in CYRILLIC.items() if len(v) > 1], out)


#: Latin letters with marks, and without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold_name(text: Column) -> Column:
    """For searching: lower case, Latin, no marks, runs of anything else one space."""
    return F.btrim(F.regexp_replace(F.translate(transliterate(F.lower(text)), MARKED, PLAIN), "[^a-z0-9]+", " "))


def source_ids(ids: Column) -> Column:
    """Distinct, sorted; null for none."""
    clean = F.array_sort(F.array_distinct(F.array_compact(ids)))
    return F.when(F.size(clean) > 0, clean)


def backoff_ms(attempt: Column, u: Column, base: int, most: int) -> Column:
    """Full jitter: a share u of base doubled for each attempt, capped."""
    return F.floor(u * F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))).cast("long")
