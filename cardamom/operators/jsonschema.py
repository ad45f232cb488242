"""JSON Schema compiled to Columns: every error of a JSON text, with its place, found inside the JVM.

A schema is compiled once, on the driver, to one expression over a VARIANT, which walks nested
objects and arrays by higher-order functions. It has no UDF and no inferred schema, and missing keys,
nulls and empty values stay apart, as does an unknown key at any depth.

Errors are struct<path, keyword, message, detail>: path is a JSON pointer ('' for the whole text), detail the
key or value that the keyword asks for. They come in the order of the schema's keywords and of the text's items.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "array<struct<path: string, keyword: string, message: string, detail: string>>"
# Keywords that say nothing about validity.
ANNOTATIONS = frozenset("$schema $id $comment $defs definitions title description default examples deprecated readOnly writeOnly".split())
#: Messages, which are those that JSON Schema validators for JavaScript give.
MESSAGES = {
    "json": "must be JSON", "false schema": "boolean schema is false", "const": "must be equal to constant", "enum": "must be equal to one of the allowed values", "additionalProperties": "must NOT have additional properties",
    "not": "must NOT be valid", "anyOf": "must match a schema in anyOf", "oneOf": "must match exactly one schema in oneOf", "uniqueItems": "must NOT have duplicate items",
}
_DAY = r"^\d{4}-\d\d-\d\d"
_TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d(:?\d\d)?)$"
#: Kinds of values by what Spark calls the type of a VARIANT: its name, or how it begins.
_KINDS = {"object": ((), ("OBJECT",)), "array": ((), ("ARRAY",)), "string": (("STRING",), ()), "boolean": (("BOOLEAN",), ()), "null": (("VOID",), ()), "number": (("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"), ("DECIMAL",))}

Body = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast(ERRORS)


def _all(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    # flatten() and concat() would find out the type of all that is below them for each value; most parts are empty
    joined = lambda found, x: F.when(F.size(x) == 0, found).when(F.size(found) == 0, x).otherwise(F.concat(found, x))
    return parts[0] if len(parts) == 1 else F.reduce(F.array(*parts), _none(), joined) if parts else _none()


def _let(value: Column, body: Body) -> Column:
    """body's errors for a value that is computed once, however often body uses it."""
    return F.reduce(F.array(value), _none(), lambda _, x: body(x))


def _pointer(path: Column, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else key.cast("string")
    return F.concat(path, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _is(kind: Column, *names: str) -> Column:
    whole, begun = [x for n in names for x in _KINDS[n][0]], [x for n in names for x in _KINDS[n][1]]
    fits = [kind == whole[0]] if len(whole) == 1 else [kind.isin(whole)] if whole else []
    return functools.reduce(operator.or_, [*fits, *(kind.startswith(x) for x in begun)])


def _kind(value: Column, *opened: Column) -> Column:
    """What Spark calls the type of a VARIANT. `opened` are the value as a map and as an array, null if it is none: with them nothing below it is looked at."""
    kind = F.schema_of_variant(value)
    for as_one, name in zip(opened, ("OBJECT", "ARRAY"), strict=False):
        kind = F.when(as_one.isNotNull(), F.lit(name)).otherwise(kind)
    return kind


def _date(text: Column) -> Column:
    return text.rlike(_DAY) & F.substring(text, 1, 10).try_cast("date").isNotNull()


FORMATS: dict[str, Body] = {
    "date": lambda s: (F.length(s) == 10) & _date(s),
    "date-time": lambda s: s.rlike(_DAY + r"[Tt ]" + _TIME) & _date(s),
    "email": lambda s: s.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*$"),
    "uri": lambda s: s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"\\^`{|}]+$"),
}


class Schema:
    """A compiled schema. `others` holds the documents that it refers to, by their `$id`.

    ValueError for what it can't compile: unknown keywords and formats, references that lead nowhere or to themselves.
    """

    def __init__(self, schema: dict | bool, others: Iterable[dict] = ()) -> None:
        self._documents = {d.get("$id", ""): d for d in others}
        self._root = schema
        self._id = schema.get("$id", "") if isinstance(schema, dict) else ""
        self._documents[self._id] = schema
        self.errors(F.lit(""))  # what can't be compiled is an error here

    def errors(self, text: Column) -> Column:
        """All errors of a JSON text; a null text, or one that is no JSON, has one."""
        whole = self._bound(self._root, self._id, ())
        return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), self._one(F.lit(""), "json")).otherwise(whole(v, F.lit(""))))

    @staticmethod
    def _one(path: Column, keyword: str, message: str | None = None, detail: Column | str | None = None) -> Column:
        detail = F.lit(detail) if detail is None or isinstance(detail, str) else detail
        return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), F.lit(message or MESSAGES[keyword]).alias("message"), detail.cast("string").alias("detail"))).cast(ERRORS)

    def _unless(self, ok: Column, path: Column, keyword: str, message: str | None = None, detail: Column | str | None = None) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(self._one(path, keyword, message, detail))

    def _bound(self, schema: dict | bool, document: str, within: tuple[str, ...]) -> Callable[[Column, Column], Column]:
        """A function from a value and its path to its errors."""
        if schema is True or schema == {}:
            return lambda v, path: _none()
        if schema is False:
            return lambda v, path: self._one(path, "false schema")
        if not isinstance(schema, dict):
            raise ValueError(f"no schema: {schema!r}")
        unknown = set(schema) - ANNOTATIONS - set(_KEYWORDS) - set(_OF_OBJECTS) - _BESIDE
        if unknown:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")

        def errors(v: Column, path: Column) -> Column:
            named = [k for k in schema if k in _KEYWORDS and k not in _OF_OBJECTS]
            of_keys = [k for k in schema if k in _OF_OBJECTS]

            # an object becomes a map once, for all keywords that bear on its keys, and an array one of values
            opened = ["map<string, variant>"] if of_keys or "items" in schema else []
            opened += ["array<variant>"] if "items" in schema else []

            def found(x: Column) -> Column:
                value, kind = x["v"], x["kind"]
                parts = [_KEYWORDS[k](self, schema, value, kind, path, document, within) for k in named]
                if of_keys:
                    inside = _all(_OF_OBJECTS[k](self, schema, x["o0"], path, document, within) for k in of_keys)
                    parts.append(F.when(x["o0"].isNotNull(), inside).otherwise(_none()))
                return _all(parts)

            if not named and not of_keys:
                return _none()
            if not opened:
                return _let(F.struct(v.alias("v"), _kind(v).alias("kind")), found)
            known = F.struct(v.alias("v"), *(v.try_cast(t).alias(f"o{i}") for i, t in enumerate(opened)))
            if not named:  # keywords of keys alone ask for no kind
                return _let(F.struct(v.alias("v"), F.lit("").alias("kind"), v.try_cast(opened[0]).alias("o0")), found)
            with_kind = lambda x: F.struct(x["v"].alias("v"), _kind(x["v"], *(x[f"o{i}"] for i in range(len(opened)))).alias("kind"), *(x[f"o{i}"].alias(f"o{i}") for i in range(len(opened))))
            return _let(known, lambda x: _let(with_kind(x), found))

        return errors

    def _resolved(self, ref: str, document: str) -> tuple[dict | bool, str]:
        name, _, pointer = ref.partition("#")
        name = name or document
        if name not in self._documents:
            raise ValueError(f"unknown reference {ref!r}")
        at: Any = self._documents[name]
        for part in pointer.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"unknown reference {ref!r}")
            at = at[part]
        return at, name

    # Keywords. Each gets the schema, a value, its kind and path, and where the schema stands; it gives an array of errors.

    def _ref(self, s, v, kind, path, document, within):
        found, name = self._resolved(s["$ref"], document)
        key = f"{name}#{s['$ref'].partition('#')[2]}"
        if key in within:
            raise ValueError(f"recursive reference {s['$ref']!r}")
        return self._bound(found, name, (*within, key))(v, path)

    def _type(self, s, v, kind, path, document, within):
        names = [s["type"]] if isinstance(s["type"], str) else list(s["type"])
        plain = [n for n in names if n != "integer"]
        if set(plain) - set(_KINDS):
            raise ValueError(f"unknown types: {names}")
        ok = _is(kind, *plain) if plain else F.lit(False)
        if "integer" in names:
            number = v.try_cast("double")
            ok = ok | (_is(kind, "number") & (number == F.floor(number)))
        return self._unless(ok, path, "type", f"must be {','.join(names)}", ",".join(names))

    @staticmethod
    def _equal(v: Column, kind: Column, value: Any) -> Column:
        if value is None:
            return _is(kind, "null")
        if isinstance(value, bool):
            return _is(kind, "boolean") & (v.try_cast("boolean") == F.lit(value))
        if isinstance(value, (int, float)):
            return _is(kind, "number") & (v.try_cast("double") == F.lit(float(value)))
        if isinstance(value, str):
            return _is(kind, "string") & (v.try_cast("string") == F.lit(value))
        # the keys of a VARIANT are in one order
        return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))

    def _const(self, s, v, kind, path, document, within):
        return self._unless(self._equal(v, kind, s["const"]), path, "const", None, json.dumps(s["const"], ensure_ascii=False))

    def _enum(self, s, v, kind, path, document, within):
        texts = [x for x in s["enum"] if isinstance(x, str)]
        ok = F.coalesce(_is(kind, "string") & v.try_cast("string").isin(texts), F.lit(False)) if texts else F.lit(False)
        for value in (x for x in s["enum"] if not isinstance(x, str)):
            ok = ok | F.coalesce(self._equal(v, kind, value), F.lit(False))
        return self._unless(ok, path, "enum", None, json.dumps(s["enum"], ensure_ascii=False))

    @staticmethod
    def _of(kind_name: str, cast: str, keyword: str, ok: Callable[[Column, Any], Column], message: str):
        """A keyword that bears on values of one kind alone."""

        def check(self, s, v, kind, path, document, within):
            limit = s[keyword]
            fits = ~_is(kind, kind_name) | ok(v.try_cast(cast), limit)
            return self._unless(fits, path, keyword, message.format(limit), str(limit))

        return check

    def _format(self, s, v, kind, path, document, within):
        if s["format"] not in FORMATS:
            raise ValueError(f"unknown format {s['format']!r}")
        ok = ~_is(kind, "string") | FORMATS[s["format"]](v.try_cast("string"))
        return self._unless(ok, path, "format", f'must match format "{s["format"]}"', s["format"])

    def _unique(self, s, v, kind, path, document, within):
        items = F.transform(v.try_cast("array<variant>"), lambda x: F.to_json(x))
        return self._unless(~_is(kind, "array") | F.lit(not s["uniqueItems"]) | (F.size(items) == F.size(F.array_distinct(items))), path, "uniqueItems")

    # Keywords of objects. They get the object as a map.

    def _required(self, s, m, path, document, within):
        lacking = F.filter(F.array(*map(F.lit, s["required"])).cast("array<string>"), lambda k: ~F.call_function("map_contains_key", m, k))
        return F.transform(lacking, lambda k: F.struct(path.alias("path"), F.lit("required").alias("keyword"), F.concat(F.lit("must have required property '"), k, F.lit("'")).alias("message"), k.alias("detail"))).cast(ERRORS)

    def _properties(self, s, m, path, document, within):
        of = {k: self._bound(sub, document, within) for k, sub in s["properties"].items()}
        return _all(F.when(F.map_contains_key(m, k), f(m[k], _pointer(path, k))).otherwise(_none()) for k, f in of.items())

    def _patterns(self, s, m, path, document, within):
        of = [(p, self._bound(sub, document, within)) for p, sub in s["patternProperties"].items()]
        return _all(F.flatten(F.transform(F.filter(F.map_entries(m), lambda e: e["key"].rlike(p)), lambda e: f(e["value"], _pointer(path, e["key"])))) for p, f in of)

    def _additional(self, s, m, path, document, within):
        known = F.array(*map(F.lit, s.get("properties", {}))).cast("array<string>")

        def other(e):
            free = ~F.array_contains(known, e["key"])
            for p in s.get("patternProperties", {}):
                free = free & ~e["key"].rlike(p)
            return free

        others = F.filter(F.map_entries(m), other)
        if s["additionalProperties"] is False:
            return F.transform(others, lambda e: F.struct(path.alias("path"), F.lit("additionalProperties").alias("keyword"), F.lit(MESSAGES["additionalProperties"]).alias("message"), e["key"].alias("detail"))).cast(ERRORS)
        sub = self._bound(s["additionalProperties"], document, within)
        return F.flatten(F.transform(others, lambda e: sub(e["value"], _pointer(path, e["key"]))))

    def _items(self, s, v, kind, path, document, within):
        sub = self._bound(s["items"], document, within)
        found = F.flatten(F.transform(v.try_cast("array<variant>"), lambda x, i: sub(x, _pointer(path, i))))
        return F.when(_is(kind, "array"), found).otherwise(_none())

    def _all_of(self, s, v, kind, path, document, within):
        return _all(self._bound(sub, document, within)(v, path) for sub in s["allOf"])

    def _valid(self, schema, v, path, document, within) -> Column:
        return F.size(self._bound(schema, document, within)(v, path)) == 0

    def _any_of(self, s, v, kind, path, document, within):
        ok = F.lit(False)
        for sub in s["anyOf"]:
            ok = ok | self._valid(sub, v, path, document, within)
        return self._unless(ok, path, "anyOf")

    def _one_of(self, s, v, kind, path, document, within):
        n = F.lit(0)
        for sub in s["oneOf"]:
            n = n + self._valid(sub, v, path, document, within).cast("int")
        return self._unless(n == 1, path, "oneOf")

    def _not(self, s, v, kind, path, document, within):
        return self._unless(~self._valid(s["not"], v, path, document, within), path, "not")

    def _if(self, s, v, kind, path, document, within):
        def branch(name):
            if name not in s:
                return _none()
            told = self._one(path, "if", f'must match "{name}" schema', name)
            return _let(self._bound(s[name], document, within)(v, path), lambda e: F.when(F.size(e) > 0, F.concat(e, told)).otherwise(e))

        return F.when(self._valid(s["if"], v, path, document, within), branch("then")).otherwise(branch("else"))


_OF_OBJECTS: dict[str, Callable[..., Column]] = {"required": Schema._required, "properties": Schema._properties, "patternProperties": Schema._patterns, "additionalProperties": Schema._additional}
#: Keywords that others read.
_BESIDE = frozenset({"then", "else"})
_KEYWORDS: dict[str, Callable[..., Column]] = {
    "$ref": Schema._ref,
    "type": Schema._type,
    "const": Schema._const,
    "enum": Schema._enum,
    "minLength": Schema._of("string", "string", "minLength", lambda x, n: F.length(x) >= n, "must NOT have fewer than {} characters"),
    "maxLength": Schema._of("string", "string", "maxLength", lambda x, n: F.length(x) <= n, "must NOT have more than {} characters"),
    "pattern": Schema._of("string", "string", "pattern", lambda x, p: x.rlike(p), 'must match pattern "{}"'),
    "format": Schema._format,
    "minimum": Schema._of("number", "double", "minimum", lambda x, n: x >= n, "must be >= {}"),
    "maximum": Schema._of("number", "double", "maximum", lambda x, n: x <= n, "must be <= {}"),
    "exclusiveMinimum": Schema._of("number", "double", "exclusiveMinimum", lambda x, n: x > n, "must be > {}"),
    "exclusiveMaximum": Schema._of("number", "double", "exclusiveMaximum", lambda x, n: x < n, "must be < {}"),
    "multipleOf": Schema._of("number", "double", "multipleOf", lambda x, n: x / F.lit(float(n)) == F.floor(x / F.lit(float(n))), "must be multiple of {}"),
    "minItems": Schema._of("array", "array<variant>", "minItems", lambda x, n: F.size(x) >= n, "must NOT have fewer than {} items"),
    "maxItems": Schema._of("array", "array<variant>", "maxItems", lambda x, n: F.size(x) <= n, "must NOT have more than {} items"),
    "uniqueItems": Schema._unique,
    "items": Schema._items,
    "allOf": Schema._all_of,
    "anyOf": Schema._any_of,
    "oneOf": Schema._one_of,
    "not": Schema._not,
    "if": Schema._if,
}


def validated(rows: DataFrame, json_text: str, schema: Schema, column: str = "_validation_errors") -> DataFrame:
    """rows with the list of errors of their JSON text, empty if it is valid."""
    return rows.withColumn(column, schema.errors(F.col(json_text)))


def split(rows: DataFrame, json_text: str, schema: Schema, column: str = "_validation_errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows with their errors)."""
    marked = validated(rows, json_text, schema, column)
    return marked.where(F.size(column) == 0).drop(column), marked.where(F.size(column) > 0)


def rendered(errors: Column) -> Column:
    """Errors as one line, in the form `path: message; path: message`."""
    return F.array_join(F.transform(errors, lambda e: F.concat(F.when(e["path"] == "", F.lit("(root)")).otherwise(e["path"]), F.lit(": "), e["message"])), "; ")
