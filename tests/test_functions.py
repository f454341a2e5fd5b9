"""Column functions at their edges."""

from pyspark.sql import functions as F

from emberline.functions import geo, text


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first().asDict()


def test_canonical_places_and_times(spark):
    got = one(spark, a=text.canonical_degrees(F.lit("-0.000001")), b=text.canonical_degrees(F.lit("42.123455")), c=text.canonical_degrees(F.lit("1e3")), d=text.canonical_acq_iso(F.lit("2024-01-02"), F.lit("5")), e=text.canonical_acq_iso(F.lit("2024-01-02"), F.lit("2400")))
    assert got == {"a": "0.00000", "b": "42.12346", "c": None, "d": "2024-01-02T00:05:00Z", "e": None}


def test_quiet_hours_pass_midnight_and_shift_with_the_clock(spark):
    at = lambda x: F.to_timestamp(F.lit(x))
    quiet = lambda x, a, b: text.in_quiet_hours(at(x), F.lit("Europe/Sofia"), F.lit(a), F.lit(b))
    got = one(spark, summer=quiet("2024-07-01 04:30:00", "22:00", "07:00"), winter=quiet("2024-01-01 04:30:00", "22:00", "07:00"), evening=quiet("2024-01-01 20:00:00", "22:00", "07:00"), never=quiet("2024-01-01 20:00:00", "07:00", "07:00"), day=quiet("2024-01-01 10:00:00", "11:00", "13:00"))
    assert got == {"summer": False, "winter": True, "evening": True, "never": False, "day": True}


def test_names_cells_and_labels(spark):
    got = one(spark, name=text.fold_name(F.lit("  Велико-Търново  Café ")), ending=text.fold_name(F.lit("София")), cell=text.csv_cell(F.lit('-1,"x"')), label=text.label_escape(F.lit('a"\\\n')), xml=text.xml_unescape(text.xml_escape(F.lit("<a & 'b'>"))))
    assert got == {"name": "veliko tarnovo cafe", "ending": "sofia", "cell": '"\'-1,""x"""', "label": 'a\\"\\\\\\n', "xml": "<a & 'b'>"}


def test_free_text_is_redacted(spark):
    got = one(spark, a=text.redact(F.lit("write to a.b@c.org with Bearer abcdefgh12")))["a"]
    assert "a.b@c.org" not in got and "abcdefgh12" not in got and got.startswith("write to [email]")


def test_boxes_round_the_antimeridian(spark):
    inside = lambda lon: geo.in_wrapping_box(F.lit(lon), F.lit(0.0), F.lit(170.0), F.lit(-1.0), F.lit(-170.0), F.lit(1.0))
    assert one(spark, a=inside(175.0), b=inside(-175.0), c=inside(0.0)) == {"a": True, "b": True, "c": False}


def test_cells_of_a_disc_hold_all_points_within(spark):
    rows = spark.range(400).select((42 + (F.col("id") % 20 - 10) / 40).alias("lat"), (25 + (F.floor(F.col("id") / 20) - 10) / 40).alias("lon"))
    cells = geo.cells_within(F.lit(42.01), F.lit(25.02), F.lit(15.0))
    near = rows.filter(geo.planar_km(F.lit(42.01), F.lit(25.02), F.col("lat"), F.col("lon")) <= 15)
    assert near.count() > 20 and near.filter(~F.array_contains(cells, geo.cell(F.col("lat"), F.col("lon")))).count() == 0


def test_typed_coordinates(spark):
    from emberline.functions import parsing

    want = {
        "42.69, 23.32": (42.69, 23.32), "42.69 23.32": (42.69, 23.32), "42.69;23.32": (42.69, 23.32), "42,69 23,32": (42.69, 23.32), "42,69; 23,32": (42.69, 23.32), "42,69": (42, 69), "42.69 23,32": None, "123.5, 45": (45, 123.5),
        "91 181": None, "42,5,23,5": None, "42°30'15\"N, 23°15'E": (42.504167, 23.25), "42N 23E": (42, 23), "23°E 42°N": (42, 23), "42 30'N 23W": (42.5, -23), "С42": None, "42°С 23°И": (42, 23), "42°30′N 23° 15’ 0'' W": (42.5, -23.25),
        "-42N 23E": None, "42'N 23E": None, "42°61'N 23E": None, "42N 43N": None, "near 42, or so": None, "": None, "42°N": None, "N42 E23": None, "+42.5 , -23.5": (42.5, -23.5), "−42.5 23": (-42.5, 23), "42.5° N; 23.25° e": (42.5, 23.25),
        "1234 5": None, "42°30N 23E": None, "42.5 n,23.5 w": (42.5, -23.5), "42\"N 23E": None, "42°5\"N 23E": (42.001389, 23),
    }
    rows = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string").select("t", parsing.coordinates(F.col("t")).alias("c")).collect()
    got = {r["t"]: None if r["c"] is None else (round(r["c"]["lat"], 6), round(r["c"]["lon"], 6)) for r in rows}
    assert got == {t: c and tuple(map(float, c)) for t, c in want.items()} | {None: None}


def test_public_addresses_against_python(spark):
    import ipaddress
    import random

    from emberline.functions import parsing

    rng = random.Random(6)
    six = [ipaddress.IPv6Address(rng.choice([0x2001 << 112, 0x20010DB8 << 96, 0x2002 << 112, 0x3FFF << 112, 0xFFFF << 32, 0x64FF9B << 96, 0, 0x2A00 << 112, 0xFE80 << 112]) + rng.getrandbits(rng.choice([1, 32, 40, 100]))) for _ in range(400)]
    four = [ipaddress.IPv4Address(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8]) << 24 | rng.getrandbits(24)) for _ in range(300)]
    texts = [str(x) for x in six + four] + [x.exploded.upper() for x in six[:100]] + ["1::2::3", "::g", "1:2:3", "01.2.3.4", "1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:8.8.8.8", ":1", "1:", "fe80::1%a"]

    def within(x, nets):
        return any(x in ipaddress.ip_network(n) for n in nets)

    def plain(t):
        try:
            x = ipaddress.ip_address(t)
        except ValueError:
            return False
        if x.version == 6 and within(x, parsing.EMBEDDING_V6):
            x = ipaddress.IPv4Address(int(x) & 0xFFFFFFFF)
        return not within(x, parsing.RESERVED_V4) if x.version == 4 else within(x, [parsing.GLOBAL_V6]) and not within(x, parsing.RESERVED_V6)

    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in texts if "%" not in t], "t string").select("t", parsing.is_public(F.col("t")).alias("p")).collect()}
    assert got == {t: plain(t) for t in got}
