"""Swaths and mixtures against plain Python, with gaps, hot keys, ties, repeats, nulls and empty tables."""

import math
import random
from collections import Counter

import pytest

from emberline import params as p
from emberline.operators import mixture, swath
from emberline.plans import surfaces

SAMPLES = "satellite long, t_s long, lat double, lon double, source string"
BOX = (19.0, 34.0, 29.0, 42.0)


def far(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * p.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def unit(lat, lon):
    la, lo = math.radians(lat), math.radians(lon)
    return (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute(rows, swath_km):
    out = {}
    for sat in {r[0] for r in rows}:
        at = {r[1]: (r[2], r[3]) for r in rows if r[0] == sat}
        lo, hi = min(at), max(at)
        hits = {t: p_[0] is not None and p_[1] is not None and far(p_, (min(42, max(34, p_[0])), min(29, max(19, p_[1])))) <= swath_km / 2 for t, p_ in at.items()}
        t = lo
        while t <= hi:
            if hits.get(t):
                a = t
                while hits.get(t + 30):
                    t += 30
                track = [(k, *at[k]) for k in range(a - 30, t + 31, 30) if k in at and None not in at[k]]
                if a > lo and t < hi and len(track) >= 2:
                    out[sat, a] = (t, min(track, key=lambda x: (far(x[1:], (38, 24)), x[0]))[0], [x[0] for x in track])
            t += 30
    return out


def flight(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lat, lon = 38 + 30 * math.sin(k / 7), (k * 3.3 + seed * 40) % 360 - 180
        none = rng.random() < 0.05
        if rng.random() > 0.03:
            rows.append((seed, k * 30, None if none else lat, lon, "x"))
    return rows


def test_samples_are_listed_after_they_are_dealt(spark, sf_dir):
    plan = swath.near(surfaces.samples(spark, sf_dir), BOX, 2400.0, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("explode(sequence((slot") < plan.index("Exchange")
    given = swath.near(spark.createDataFrame(flight(300, 1), SAMPLES), BOX, 2400.0, 30)
    assert given._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and given.count() < 200


@pytest.mark.parametrize("stretch", [4, 2048])
def test_passes_are_those_of_a_plain_scan(spark, monkeypatch, stretch):
    monkeypatch.setattr(swath, "STRETCH", stretch)  # runs go over many stretches where these are short
    rows = [r for seed, n in ((1, 1500), (2, 200), (3, 90)) for r in flight(n, seed)]
    want = brute(rows, 2400.0)
    got = swath.passes(spark.createDataFrame(rows + rows[:40], SAMPLES), BOX, 2400.0, 30).collect()
    assert len(want) > 10 and {(r["satellite"], r["start_s"]): (r["end_s"], r["mid_s"], [x["t_s"] for x in r["track"]]) for r in got} == want
    for r in got:
        track = [(x["lat"], x["lon"]) for x in r["track"]]
        assert len(r["left"]) == len(r["right"]) == len(track) and r["ring"][0] == r["ring"][-1] and len(r["ring"]) == 2 * len(track) + 1
        assert 34.2 <= r["label"]["lat"] <= 41.8 and 19.2 <= r["label"]["lon"] <= 28.8
        for i, (here, l, s) in enumerate(zip(track, r["left"], r["right"], strict=True)):
            a, b = (here, track[i + 1]) if i + 1 < len(track) else (track[i - 1], here)
            pole, on = cross(unit(*a), unit(*b)), unit(*here)
            for edge, sign in ((l, 1), (s, -1)):
                e = (edge["lat"], edge["lon"])
                assert far(here, e) == pytest.approx(1200, abs=1e-6) and sign * dot(pole, unit(*e)) > 0
                if i + 1 < len(track):  # at right angles: the edge is in the plane of the place and the track's pole
                    assert abs(dot(cross(on, pole), unit(*e))) < 1e-9


def test_runs_at_the_ends_and_windows(spark):
    inside, outside = (38.0, 24.0), (-38.0, -120.0)
    rows = [(7, 30 * k, *(inside if c == "i" else outside), None) for k, c in enumerate("iioiiioioii")]
    df = spark.createDataFrame(rows, SAMPLES)
    every = swath.passes(df, BOX, 1000.0, 30)
    assert sorted((r["start_s"], r["mid_s"], r["end_s"]) for r in every.collect()) == [(90, 90, 150), (210, 210, 210)]
    assert [r["start_s"] for r in swath.passes(df, BOX, 1000.0, 30, (91, 211)).collect()] == [210]
    assert swath.passes(df.limit(0), BOX, 1000.0, 30).collect() == []


def shares(weights, scale):
    total = sum(weights)
    if total <= 0:
        return ""
    exact = [w * scale / total for w in weights]
    own = [math.floor(x) for x in exact]
    for i in sorted(range(len(own)), key=lambda i: (own[i] - exact[i], i))[: scale - sum(own)]:
        own[i] += 1
    return ",".join(map(str, own))


def coarse(pixels, groups, factor, scale, rows, cols):
    sums = {}
    for r, c, g, w in pixels:
        if g is not None and 0 <= g < groups and r is not None and c is not None and 0 <= r < rows and 0 <= c < cols:
            sums.setdefault((r // factor, c // factor), [0.0] * groups)[g] += w or 0
    high, wide = -(-rows // factor), -(-cols // factor)
    keys = [[shares(sums.get((r, c), [0.0] * groups), scale) for c in range(wide)] for r in range(high)]
    often = Counter(k for row in keys for k in row)
    order = {k: i for i, (k, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0])))}
    lines = []
    for row in keys:
        runs = []
        for k in row:
            if runs and runs[-1][0] == order[k]:
                runs[-1][1] += 1
            else:
                runs.append([order[k], 1])
        lines.append([tuple(x) for x in runs])
    return lines, {(order[k], k, n) for k, n in often.items()}


def check(spark, pixels, groups, factor, scale, rows, cols):
    df = spark.createDataFrame(pixels, "row long, col long, group int, weight double")
    runs, names = mixture.down_sampled(df, groups, factor, scale, rows, cols)
    lines, held = coarse(pixels, groups, factor, scale, rows, cols)
    got = {r["row"]: [(x["index"], x["length"]) for x in r["runs"]] for r in runs.collect()}
    assert got == dict(enumerate(lines))
    assert {(r["index"], r["key"], r["n"]) for r in names.collect()} == held


@pytest.mark.parametrize("few", [1, 1_000_000])  # with a join that shuffles, and with a broadcast
def test_mixtures_of_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(mixture, "FEW", few)
    rng = random.Random(5)
    pixels = [(rng.randrange(-2, 50), rng.randrange(70), rng.choice([0, 0, 0, 1, 2, 3, 9, None]), float(rng.randrange(4))) for _ in range(900)]
    pixels += [(r, c, 2, 1.0) for r in range(24, 40) for c in range(0, 30)] + [(None, 3, 1, 1.0), (3, None, 1, 1.0), (4, 4, 1, None)]
    check(spark, pixels, 4, 3, 10, 50, 70)


def test_full_and_empty_grids(spark):
    check(spark, [(r, c, (r + c) % 2, 1.0) for r in range(7) for c in range(5)], 2, 2, 7, 7, 5)  # no block is empty, the far sides are partial
    check(spark, [], 3, 4, 10, 9, 9)
    check(spark, [(8, 8, 2, 5.0)], 3, 4, 10, 9, 9)
    with pytest.raises(ValueError, match="factor"):
        check(spark, [], 3, 0, 10, 9, 9)
