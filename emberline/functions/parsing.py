"""Column functions that read or write small texts: coordinates, addresses, fragments, instants, path segments, shares, tiles."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def iso_millis(text: Column) -> Column:
    """Milliseconds of a UTC instant with a Z; null for anything else."""
    return F.unix_millis(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,3})?Z$"), F.try_to_timestamp(text)))


def lenient_instant(text: Column) -> Column:
    """An instant of any ISO form, without a zone in UTC; null if it is none."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), text))


def cycle_seconds(day: Column, hour: Column) -> Column:
    """Seconds of a forecast cycle: yyyymmdd and an hour."""
    return F.unix_seconds(F.try_to_timestamp(day, F.lit("yyyyMMdd"))) + hour * 3600


#: Letters of hemispheres, Latin and Cyrillic, and the Latin ones they stand for; marks of minutes and seconds.
LETTERS, LATIN = "NSEWСЮИЗ", "NSEWNSEW"
MINUTE_MARKS, SECOND_MARKS = "′’", "″”"
_NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
#: How an angle may be put together: degrees, whose sign may be left out, then minutes, seconds, both or neither.
_ANGLES = ["#" + degrees + minutes + seconds for degrees in ("", "°") for minutes in ("", "#'") for seconds in ("", '#"')]


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _decimal_pair(s: Column) -> Column:
    """Two numbers, as an array: what separates them is a semicolon, else a comma that isn't a decimal one, else white space."""
    by_comma = s.rlike(r",\s|\s,") | ~s.rlike(r"\s")
    parts = F.when(s.contains(";"), F.split(s, r"\s*;\s*")).when(by_comma, F.split(s, r"\s*,\s*")).otherwise(F.split(s, r"\s+"))
    plain = (F.size(parts) == 2) & F.forall(parts, lambda x: x.rlike(r"^[-+]?\d{1,3}([.,]\d+)?$")) & ~(s.contains(".") & F.exists(parts, lambda x: x.contains(",")))
    return F.when(plain, F.transform(parts, _number))


def _angle(part: Column) -> Column:
    """Degrees of an angle that ends with its letter: signed, null if it is none."""
    letter, body = F.right(part, F.lit(1)), F.substring(part, F.lit(1), F.length(part) - 1)
    numbers = F.regexp_extract_all(body, F.lit(f"({_NUMBER})"), 1)
    shape = F.regexp_replace(F.regexp_replace(body, _NUMBER, "#"), r"\s", "")
    at = lambda mark, place: F.when(shape.contains(mark), _number(F.get(numbers, place))).otherwise(0.0)
    minutes = at("'", F.lit(1))
    seconds = at('"', F.when(shape.contains("'"), 2).otherwise(1))
    short = F.get(numbers, F.lit(0)).rlike(r"^[-+]?\d{1,3}([.,]|$)") & F.forall(F.slice(numbers, 2, 2), lambda n: n.rlike(r"^\d{1,2}([.,]|$)"))
    degrees = _number(F.get(numbers, F.lit(0)))
    value = F.when(shape.isin(_ANGLES) & short & (degrees >= 0) & (minutes < 60) & (seconds < 60), degrees + minutes / 60 + seconds / 3600)
    return F.when(letter.isin("S", "W"), -value).otherwise(value)


def coordinates(text: Column) -> Column:
    """lat, lon of free text: two decimals in either order that is valid, or degrees with minutes, seconds and hemispheres; else null."""
    s = F.replace(F.btrim(text), F.lit("−"), F.lit("-"))
    point = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    decimal = lambda a: F.when((F.abs(a[0]) <= 90) & (F.abs(a[1]) <= 180), point(a[0], a[1])).when((F.abs(a[1]) <= 90) & (F.abs(a[0]) <= 180), point(a[1], a[0]))
    marked = F.translate(F.translate(F.translate(F.upper(s), LETTERS, LATIN), MINUTE_MARKS, "'" * len(MINUTE_MARKS)), SECOND_MARKS, '"' * len(SECOND_MARKS))
    parts = F.filter(F.split(F.replace(marked, F.lit("''"), F.lit('"')), r"(?<=[NSEW])[\s,;]*"), lambda x: x != "")
    parts = F.when((F.size(parts) == 2) & F.forall(parts, lambda x: x.rlike("[NSEW]$")), parts)
    tall = lambda x: F.right(x, F.lit(1)).isin("N", "S")
    read = lambda x: F.struct(_angle(x).alias("value"), tall(x).alias("tall"))

    def placed(p: Column) -> Column:
        lat, lon = F.when(p[0]["tall"], p[0]["value"]).otherwise(p[1]["value"]), F.when(p[0]["tall"], p[1]["value"]).otherwise(p[0]["value"])
        return F.when((p[0]["tall"] != p[1]["tall"]) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), point(lat, lon))

    return F.coalesce(_with(_decimal_pair(s), decimal), _with(F.transform(parts, read), placed))


#: Networks of IPv4 and IPv6 that are not public; the only ones of IPv6 that may be; and those that embed an IPv4 address, which decides.
RESERVED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
GLOBAL_V6, RESERVED_V6, EMBEDDING_V6 = "2000::/3", ["2001::/23", "2001:db8::/32", "3fff::/20", "2002::/16"], ["::ffff:0:0/96", "64:ff9b::/96"]


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it is none (leading zeros aren't taken)."""
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    return F.when(text.rlike(rf"^{byte}(\.{byte}){{3}}$"), number)


def _public_number(n: Column) -> Column:
    nets = [ipaddress.ip_network(x) for x in RESERVED_V4]
    return ~reduce(Column.__or__, [n.between(int(x[0]), int(x[-1])) for x in nets])


def is_public_v4(text: Column) -> Column:
    """Whether an IPv4 address is a public one; false for anything else."""
    return F.coalesce(_with(ipv4_number(text), _public_number), F.lit(False))


def ipv6_digits(text: Column) -> Column:
    """An IPv6 address as 32 hex digits; null if it is none.  Its last two groups may be an IPv4 address."""
    last = F.substring_index(text, ":", -1)
    part = lambda n: F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF))))
    two = lambda n: F.concat(part(F.shiftright(n, 16)), F.lit(":"), part(n))
    whole = F.when(text.contains("."), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(last)), _with(ipv4_number(last), two))).otherwise(F.lower(text))
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(sides: Column) -> Column:
        missing = 8 - F.size(sides["left"]) - F.size(sides["right"])
        fits = F.when(sides["n"] == 1, missing == 0).otherwise((sides["n"] == 2) & (missing >= 1))
        every = F.concat(sides["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["right"])
        return F.when(fits, every)

    sides = _with(F.split(whole, "::"), lambda h: F.struct(groups(h[0]).alias("left"), groups(F.get(h, F.lit(1))).alias("right"), F.size(h).alias("n")))
    shown = lambda every: F.when(F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(F.length(text) <= 45, _with(_with(sides, filled), shown))


def is_public(text: Column) -> Column:
    """Whether an address of either kind is a public one; false for anything else."""

    def v6(digits: Column) -> Column:
        within = lambda net: digits.between(*(f"{int(ipaddress.ip_network(net)[k]):032x}" for k in (0, -1)))
        embedded = _with(F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"), _public_number)
        return F.when(reduce(Column.__or__, map(within, EMBEDDING_V6)), embedded).otherwise(within(GLOBAL_V6) & ~reduce(Column.__or__, map(within, RESERVED_V6)))

    v4 = _with(ipv4_number(text), lambda n: F.struct(n.isNotNull().alias("is"), _public_number(n).alias("public")))
    return _with(v4, lambda n: F.when(n["is"], n["public"]).otherwise(F.coalesce(_with(ipv6_digits(text), v6), F.lit(False))))


def path_segment(text: Column) -> Column:
    """Text as a path segment: bytes other than letters, digits, '.', '_' and '-' as ~ and two hex digits, and so a leading dot."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.substr(hexes, i * 2 - 1, F.lit(2)))
    shown = F.transform(byte, lambda h: F.when(F.char(F.conv(h, 16, 10).cast("long")).rlike("^[A-Za-z0-9._-]$"), F.char(F.conv(h, 16, 10).cast("long"))).otherwise(F.concat(F.lit("~"), F.lower(h))))
    return F.when(text == "", "").otherwise(F.regexp_replace(F.array_join(shown, ""), r"^\.", "~2e"))


def fragment(text: Column) -> Column:
    """The k=v members of a fragment as a map; of a repeated key the first counts."""
    members = F.filter(F.split(F.regexp_replace(text, "^#", ""), "&"), lambda m: m.contains("="))
    keys = F.transform(members, lambda m: F.substring_index(m, "=", 1))
    first = F.filter(F.transform(members, lambda m, i: F.when(F.array_position(keys, F.substring_index(m, "=", 1)) == i + 1, m)), lambda m: m.isNotNull())
    return F.map_from_entries(F.transform(first, lambda m: F.struct(F.substring_index(m, "=", 1), F.regexp_replace(m, "^[^=]*=", ""))))


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """{name} places of a template with their values; an unknown name stays."""
    for name, value in slots.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def quantized_shares(weights: Column, scale: int) -> Column:
    """Whole shares that sum to the scale: floors first, the rest to the largest remainders (then the first); none of no weight.  Weights are whole."""
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)
    low, rest = F.transform(weights, lambda w: F.floor(w * scale / total).cast("long")), F.transform(weights, lambda w: w * scale % total)
    missing = F.lit(scale) - F.aggregate(low, F.lit(0).cast("long"), lambda a, w: a + w)
    order = F.array_sort(F.transform(rest, lambda r, i: F.struct((-r).alias("r"), i.alias("i"))))
    raised = F.transform(F.slice(order, 1, F.greatest(missing, F.lit(0)).cast("int")), lambda o: o["i"])
    shares = F.transform(low, lambda v, i: v + F.array_contains(raised, i).cast("long"))
    return F.when(total > 0, shares).otherwise(F.array().cast("array<bigint>"))


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """A tile's place in the order of zooms and, within one, along the Hilbert curve."""
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(acc: Column, k: Column) -> Column:
        s = F.expr("1L") * F.pow(F.lit(2), k).cast("long")
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        flipped = (ry == 0) & (rx == 1)
        fx, fy = F.when(flipped, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(flipped, s - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct((acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)).alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    bits = F.when(z > 0, F.reverse(F.sequence(F.lit(0), z.cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return ((F.pow(F.lit(4), z).cast("long") - 1) / 3).cast("long") + F.aggregate(bits, start, step)["d"]


def fnv_hex(text: Column) -> Column:
    """FNV-1a (32 bits) of a text's UTF-8 bytes, eight hex digits."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substr(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    value = F.aggregate(F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


#: Kinds of warnings in titles (separators as spaces) that are fires, that are heat, and that are others; and the colours of levels.
FIRE_KINDS, HEAT_KINDS = ["forest fire", "forestfire", "fire"], ["high temperature", "hightemperature", "heat"]
OTHER_KINDS = ["wind", "snow ice", "snow", "ice", "thunderstorm", "thunderstorms", "fog", "low temperature", "coastal event", "coastalevent", "avalanche", "avalanches", "rain", "flooding", "flood", "rain flood"]
LEVELS = ["yellow", "orange", "red"]


def title_class(title: Column) -> Column:
    """What a warning's title says: not_relayed, unplaceable, or the level and kind of a candidate (?: an unknown kind).

    A title is a colour, a kind, the words "warning issued for", and a place.
    """
    return _with(F.split(F.lower(F.regexp_replace(F.btrim(title), r"\s+", " ")), " warning issued for ", 2), _said)


def _said(said: Column) -> Column:
    colour, kind = F.substring_index(said[0], " ", 1), F.btrim(F.regexp_replace(F.substring(said[0], F.instr(said[0], " "), F.length(said[0])), r"[-_/ ]+", " "))
    spoken = (F.size(said) == 2) & said[0].contains(" ") & colour.rlike(r"^\w+$")
    guess = F.when(kind.isin(FIRE_KINDS), "forest-fire").when(kind.isin(HEAT_KINDS), "high-temperature").otherwise("?")
    known = F.when(colour == "green", "not_relayed").when(~colour.isin(LEVELS), "unplaceable").when(kind.isin(OTHER_KINDS), "not_relayed").otherwise(F.concat(colour, F.lit(":"), guess))
    return F.when(spoken, known).otherwise("unplaceable")
