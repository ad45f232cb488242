"""The schema compiler, on texts whose errors are known."""

import json

import pytest
from pyspark.sql import functions as F

from cardamom.operators.jsonschema import Schema, rendered, split, validated

OTHER = {"$id": "parts.json", "$defs": {"violation": {"type": "object", "required": ["rule_id"], "additionalProperties": False, "properties": {"rule_id": {"type": "string", "pattern": r"^TXT-\d{2}$"}, "quote": {"type": ["string", "null"], "minLength": 2}}}}}
CARD = {
    "$id": "card.json",
    "title": "a card",
    "type": "object",
    "required": ["id", "lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 1},
        "kind": {"enum": ["tour", "event", None, 3]},
        "version": {"const": 1},
        "clean": {"type": "boolean"},
        "lines": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/line"}},
        "violations": {"type": "array", "items": {"$ref": "parts.json#/$defs/violation"}},
        "extra": {"type": "object", "patternProperties": {"^x_": {"type": "integer"}}, "additionalProperties": {"type": "string"}},
        "tags": {"uniqueItems": True},
        "a/b~c": {"type": "null"},
    },
    "$defs": {"line": {"type": "object", "additionalProperties": False, "required": ["order"], "properties": {"order": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100, "multipleOf": 0.5}, "ship": {"type": "object", "additionalProperties": False, "properties": {"date": {"format": "date", "type": "string"}, "at": {"format": "date-time"}}}}}},
    "allOf": [
        {"if": {"properties": {"clean": {"const": True}}, "required": ["clean"]}, "then": {"properties": {"violations": {"maxItems": 0}}}, "else": {"required": ["violations"]}},
    ],
}
GOOD = {"id": "a", "clean": True, "lines": [{"order": 1}]}

CASES = [
    (GOOD, []),
    (GOOD | {"kind": None, "version": 1.0, "tags": [1, 2], "a/b~c": None, "extra": {"x_1": 2, "y": "s"}}, []),
    (GOOD | {"lines": [{"order": 2.0, "ship": {"date": "2024-02-29", "at": "2024-02-29T23:59:60.5+03:00"}}]}, []),
    ({}, [("", "required", "id"), ("", "required", "lines"), ("", "required", "violations"), ("", "if", "else")]),
    ([], [("", "type", "object")]),
    (5, [("", "type", "object")]),
    (GOOD | {"id": ""}, [("/id", "minLength", "1")]),
    (GOOD | {"id": None}, [("/id", "type", "string")]),
    (GOOD | {"id": 7, "what": {"deep": 1}}, [("", "additionalProperties", "what"), ("/id", "type", "string")]),
    (GOOD | {"kind": "3"}, [("/kind", "enum", '["tour", "event", null, 3]')]),
    (GOOD | {"version": True}, [("/version", "const", "1")]),
    (GOOD | {"lines": []}, [("/lines", "minItems", "1")]),
    (GOOD | {"lines": [{"order": 1}] * 4}, [("/lines", "maxItems", "3")]),
    (GOOD | {"lines": [{"order": 0}, {"order": 1.5}, {"order": 100}]}, [("/lines/0/order", "minimum", "1"), ("/lines/1/order", "type", "integer"), ("/lines/2/order", "exclusiveMaximum", "100")]),
    (GOOD | {"lines": [{"order": 1, "ship": {"date": "2023-02-29", "at": "2024-01-01 24:00:00Z", "by": 1}}, "x", {}]}, [("/lines/0/ship", "additionalProperties", "by"), ("/lines/0/ship/date", "format", "date"), ("/lines/0/ship/at", "format", "date-time"), ("/lines/1", "type", "object"), ("/lines/2", "required", "order")]),
    (GOOD | {"violations": [{"rule_id": "TXT-01"}]}, [("/violations", "maxItems", "0"), ("", "if", "then")]),
    (GOOD | {"clean": False}, [("", "required", "violations"), ("", "if", "else")]),
    (GOOD | {"clean": False, "violations": [{"rule_id": "TXT-1", "quote": "a", "z": 0}, {"quote": None}]}, [("/violations/0", "additionalProperties", "z"), ("/violations/0/rule_id", "pattern", r"^TXT-\d{2}$"), ("/violations/0/quote", "minLength", "2"), ("/violations/1", "required", "rule_id")]),
    (GOOD | {"extra": {"x_1": 2.5, "x_2": "2", "y": 1, "z/": []}}, [("/extra/x_1", "type", "integer"), ("/extra/x_2", "type", "integer"), ("/extra/y", "type", "string"), ("/extra/z~1", "type", "string")]),
    (GOOD | {"tags": [{"a": 1, "b": 2}, {"b": 2, "a": 1}]}, [("/tags", "uniqueItems", None)]),
    (GOOD | {"a/b~c": 0}, [("/a~1b~0c", "type", "null")]),
]


def test_errors_and_their_places(spark):
    texts = [(i, json.dumps(card)) for i, (card, _) in enumerate(CASES)] + [(-1, "{broken"), (-2, None), (-3, "")]
    rows = validated(spark.createDataFrame(texts, "n int, card string"), "card", Schema(CARD, [OTHER])).collect()
    got = {r["n"]: sorted((e["path"], e["keyword"], e["detail"] or "") for e in r["_validation_errors"]) for r in rows}
    for i, (card, errors) in enumerate(CASES):
        assert got[i] == sorted((p, k, d or "") for p, k, d in errors), card
    assert got[-1] == got[-2] == got[-3] == [("", "json", "")]


def test_split_and_messages(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(GOOD | {"id": "", "b": 1, "lines": [{"order": 0}]}),)], "card string")
    good, bad = split(df, "card", Schema(CARD, [OTHER]))
    assert good.columns == ["card"] and good.count() == 1
    line = bad.select(rendered(F.col("_validation_errors"))).first()[0]
    assert line.split("; ") == ["(root): must NOT have additional properties", "/id: must NOT have fewer than 1 characters", "/lines/0/order: must be >= 1"]
    assert good.limit(0).count() == 0


def test_alternatives(spark):
    schema = Schema({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}], "oneOf": [{"type": "integer"}, {"type": "number"}, {"type": "string"}], "not": {"const": "no"}})
    df = spark.createDataFrame([(x,) for x in ('"yes"', '"no"', "7", "7.5", "1", "null")], "j string")
    got = {r["j"]: [e["keyword"] for e in r["e"]] for r in df.select("j", schema.errors(F.col("j")).alias("e")).collect()}
    assert got == {'"yes"': [], '"no"': ["not"], "7": ["oneOf"], "7.5": [], "1": ["anyOf", "oneOf"], "null": ["anyOf", "oneOf"]}


@pytest.mark.parametrize("schema", [{"typ": "string"}, {"type": "text"}, {"format": "colour"}, {"$ref": "#/$defs/none"}, {"$ref": "none.json"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"properties": {"a": {"items": {"wrong": 1}}}}, {"items": 5}])
def test_schemas_that_cannot_be_compiled(spark, schema):
    with pytest.raises(ValueError):
        Schema(schema)


def test_no_python_in_the_plan(spark):
    plan = validated(spark.createDataFrame([("{}",)], "card string"), "card", Schema(CARD, [OTHER]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_kinds_are_not_matched_as_patterns(spark):
    """What is asked of every value is cheap: no patterns, and no array is flattened or concatenated for parts that are empty."""
    rows = spark.createDataFrame([('{"a": "x", "b": [1, "y"]}',)], "j string")
    schema = Schema({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": ["integer", "null"]}}}})
    checked = validated(rows, "j", schema, "e")
    assert [(e["path"], e["keyword"]) for e in checked.first()["e"]] == [("/b/1", "type")]
    assert "RLIKE" not in checked._jdf.queryExecution().optimizedPlan().toString().upper()
