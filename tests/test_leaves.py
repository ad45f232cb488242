"""Leaves of JSON of unknown shape."""

import json

from cardamom.operators import leaves, validation
from cardamom.session import stored


def plain(value, path=""):
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain(v, f"{path}[{i}]")]
    return []


CARDS = [{"a": "x", "b": [{"c": ["y", 1, None, "z"]}, "w"]}, ["p", ["q", {}], []], "alone", 5, None, {"": {"é": ""}, "n": {"m": {"o": [[[["deep"]]]]}}}, {}]


def test_any_shapes_in_one_table(spark):
    rows = [(i, json.dumps(c)) for i, c in enumerate(CARDS)] + [(100, None), (101, "{broken"), (102, "")]
    got = leaves.flatten_json(spark.createDataFrame(rows, "id int, card string"), "card", ["id"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *leaf) for i, c in enumerate(CARDS) for leaf in plain(c))
    claims = spark.createDataFrame([(0, "b[0].c[1]", "y"), (0, "b[0].c[3]", "z"), (1, "[1][0]", "q"), (5, "n.m.o[0][0][0][0]", "ee")], "id int, path string, quote string")
    assert {r["path"]: r["found"] for r in validation.quoted(claims, got, "id").collect()} == {"b[0].c[1]": False, "b[0].c[3]": True, "[1][0]": True, "n.m.o[0][0][0][0]": True}


def test_empty_table(spark):
    assert leaves.flatten_json(spark.createDataFrame([], "id int, card string"), "card", ["id"]).count() == 0


def test_levels_are_taken_off_together(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(leaves, "stored", lambda df, name: kept.append(name) or stored(df, name))
    rows = spark.createDataFrame([('{"a": {"b": [[], [{"c": {"d": "x"}}]], "e": "y"}, "f": {}, "g": [1, null, true]}',), ('"z"',), ("[[[[[[[[\"deep\"]]]]]]]]",)], "j string")
    got = leaves.flatten_json(rows, "j", [])
    assert {tuple(r) for r in got.collect()} == {("a.b[1][0].c.d", "x"), ("a.e", "y"), ("", "z"), ("[0]" * 8, "deep")}
    assert len(kept) == 3  # nine levels, four in a round
