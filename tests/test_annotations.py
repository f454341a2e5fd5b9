"""Strict explanations: every fault with its place, and what is read of bodies without one."""

import json

from emberline.operators import annotations

GOOD = {"key": "a", "disposition": "accepted", "reason": "r"}


def read(spark, bodies):
    rows = annotations.checked(spark.createDataFrame(list(enumerate(bodies)), "doc long, body string"), "doc")
    faults = {r["doc"]: r["fault"] for r in annotations.faults(rows, "doc").collect()}
    return faults, sorted(tuple(r) for r in annotations.explanations(rows, "doc").collect())


def test_faults_and_their_places(spark):
    entry = lambda **k: json.dumps({"explanations": [GOOD, {"key": "b", "disposition": "accepted", "reason": "r"} | k]})
    cases = [
        (None, "explanations: not an object"), ("", "explanations: not an object"), ("nonsense", "explanations: not an object"), ("[]", "explanations: not an object"), ("null", "explanations: not an object"),
        ('{"explanations": [], "z": 1, "b": 2}', "explanations.z: unknown field"), ("{}", "explanations.explanations: not an array"), ('{"explanations": "[]"}', "explanations.explanations: not an array"),
        ('{"explanations": null}', "explanations.explanations: not an array"), ('{"explanations": ["{}"]}', "explanations[0]: not an object"), ('{"explanations": [null]}', "explanations[0]: not an object"), ('{"explanations": [[1]]}', "explanations[0]: not an object"),
        (entry(zz=1, fixtureID="S1"), "explanations[1].zz: unknown field"), (entry(key="  \t"), "explanations[1].key: empty"), (entry(key=3), "explanations[1].key: empty"), (entry(key="a"), "explanations[1].key: repeated"),
        (entry(disposition="Fixture"), "explanations[1].disposition: neither fixture nor accepted"), (entry(disposition=None), "explanations[1].disposition: neither fixture nor accepted"), (entry(reason=None), "explanations[1].reason: empty"), (entry(reason=["r"]), "explanations[1].reason: empty"),
        (entry(disposition="fixture"), "explanations[1].fixtureId: empty"), (entry(disposition="fixture", fixtureId=7), "explanations[1].fixtureId: empty"), (entry(fixtureId="S1"), "explanations[1].fixtureId: for fixtures alone"), (entry(fixtureId=False), "explanations[1].fixtureId: for fixtures alone"),
        (entry(key="a", zz=1, reason=""), "explanations[1].zz: unknown field"),  # the first rule of an entry that has several
        (json.dumps({"explanations": [GOOD | {"reason": ""}, GOOD, 5]}), "explanations[0].reason: empty"),  # the first entry of several
    ]
    faults, held = read(spark, [body for body, _ in cases])
    assert faults == {i: fault for i, (_, fault) in enumerate(cases)}
    assert held == []


def test_what_is_read(spark):
    long = "x" * 200_000
    bodies = ['{"explanations": []}', json.dumps({"explanations": [GOOD, {"key": "B", "disposition": "fixture", "fixtureId": " S1", "reason": long}]}), json.dumps({"explanations": [GOOD | {"fixtureId": None, "key": 'q"\\ü'}]})]
    assert read(spark, bodies) == ({}, [(1, "B", "fixture", " S1", long), (1, "a", "accepted", None, "r"), (2, 'q"\\ü', "accepted", None, "r")])
    assert read(spark, bodies + bodies)[0] == {}  # keys may stand again in another body
    none = spark.createDataFrame([], "doc long, body string")
    assert annotations.checked(none, "doc").collect() == []
