"""The reference mask: strict reading, the version in force, and what refuses another."""

import json

import pytest

from emberline.sources import mask

TAG, KINDS = "mask@1", ["solar", "flare"]
GOOD = {"format": TAG, "version": "1", "licence": "l", "attribution": "a", "scale": 100, "kinds": KINDS, "sources": [[0, 2400, 3801], [1, 2500, 4000, 10, 0, -5, 12]]}


def read(spark, bodies):
    return mask.read(spark.createDataFrame(list(enumerate(bodies)), "file long, body string"), "file", TAG, KINDS)


def test_faults(spark):
    body = lambda **k: json.dumps(GOOD | k)
    entry = lambda *e: json.dumps(GOOD | {"sources": [[0, 1, 1], *e]})
    cases = [
        (None, "not an object"), ("", "not an object"), ("[1]", "not an object"), (body(format="mask@2"), "format"), (body(version=""), "version"), (body(version=3), "version"), (body(licence=None), "licence"), (body(attribution=[]), "attribution"),
        (body(scale=0), "scale"), (body(scale=1.5), "scale"), (body(scale="100"), "scale"), (body(kinds=["flare", "solar"]), "kinds"), (body(kinds="solar"), "kinds"), (body(sources={}), "sources"), (body(version="", scale=0), "version"),
        (entry(5), "sources[1]: not a source"), (entry([0, 1]), "sources[1]: not a source"), (entry([2, 1, 1]), "sources[1]: unknown kind"), (entry([-1, 1, 1]), "sources[1]: unknown kind"), (entry(["0", 1, 1]), "sources[1]: unknown kind"),
        (entry([0, 1, 1, 1]), "sources[1]: an odd number of coordinates"), (entry([0, 1, 1, 1, 1]), "sources[1]: two places"), (entry([0, 1, 1, 1, 0.5, 1, 1]), "sources[1]: a coordinate that isn't whole"), (entry([0, 1, 1, 1, None, 1, 1]), "sources[1]: a coordinate that isn't whole"),
        (entry([0, 18001, 0]), "sources[1]: off the globe"), (entry([0, 0, 8000, 0, 1001, 0.5, 0]), "sources[1]: off the globe"), (entry([0, 1, 1], [9, 1, 1], 7), "sources[2]: unknown kind"),
    ]
    good, bad = read(spark, [b for b, _ in cases])
    assert {r["file"]: r["fault"] for r in bad.collect()} == {i: fault for i, (_, fault) in enumerate(cases)}
    assert good.collect() == []


def test_rings_and_cells(spark):
    ring = [0, 100, 100] + [1, 0] * 30_000  # a long ring, out to 301 degrees at a scale of 100: off the globe
    wide = [1, -18000, -9000, 36000, 18000, 0, 0]
    good, bad = read(spark, [json.dumps(GOOD), json.dumps(GOOD | {"sources": []}), json.dumps(GOOD | {"sources": [ring]}), json.dumps(GOOD | {"sources": [wide]})])
    assert [tuple(r) for r in bad.collect()] == [(2, "sources[0]: off the globe")]
    rows = {(r["file"], r["index"]): r for r in good.collect()}
    assert sorted(rows) == [(0, 0), (0, 1), (3, 0)]
    assert [(v["lon"], v["lat"]) for v in rows[0, 1]["vertices"]] == [(25.0, 40.0), (25.1, 40.0), (25.05, 40.12)]
    assert (rows[3, 0]["west"], rows[3, 0]["south"], rows[3, 0]["east"], rows[3, 0]["north"]) == (-180.0, -90.0, 180.0, 90.0)
    cells = {(r["index"], r["r"], r["c"]) for r in mask.indexed(good.filter("file = 0"), 0.5).collect()}
    assert cells == {(0, 76, 48), (1, 80, 50)}


def test_the_mask_in_force(spark, tmp_path):
    root, one = f"file://{tmp_path}/mask", lambda **k: read(spark, [json.dumps(GOOD | k)])[0]
    with pytest.raises(ValueError, match="published"):
        mask.load(spark, root)
    assert mask.in_force(spark, root) is None
    assert mask.store(one(), root) == "stored" and mask.store(one(), root) == "unchanged"
    with pytest.raises(ValueError, match="other bytes under version 1"):
        mask.store(one(licence="other"), root)
    with pytest.raises(ValueError, match="one file"):
        mask.store(one(scale=0), root)  # a faulty file has no sources
    with pytest.raises(ValueError, match="one file"):
        mask.store(one().unionByName(one(version="2")), root)
    assert mask.in_force(spark, root)["version"] == "1" and mask.load(spark, root, "1").select("index").distinct().count() == 2
    assert mask.store(one(version="2", sources=[[1, 5, 5]]), root) == "stored"
    assert [r["kind"] for r in mask.load(spark, root, "2").collect()] == ["flare"]
    with pytest.raises(ValueError, match="version 2, not 1"):
        mask.load(spark, root, "1")
