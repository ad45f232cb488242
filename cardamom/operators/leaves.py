"""Text leaves of JSON whose shape nobody knows: levels of nesting are taken off until nothing nests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_CHILD = "array<struct<path: string, v: variant, leaf: boolean>>"
#: Levels of nesting that a round takes off.
LEVELS = 4


def _children() -> Column:
    """The values right below an object or an array, with their paths; a string itself; null for all else.

    What can be made a map is an object. Asking for a value's kind would look at all that is below it, level by level anew.
    """
    dot = F.when(F.col("path") == "", F.lit("")).otherwise(F.lit("."))
    child = lambda path, v: F.struct(path.alias("path"), v.alias("v"), F.lit(False).alias("leaf"))
    of_object = F.transform(F.map_entries(F.col("v").try_cast("map<string, variant>")), lambda e: child(F.concat("path", dot, e["key"]), e["value"]))
    of_array = F.transform(F.col("v").try_cast("array<variant>"), lambda x, i: child(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), x))
    itself = F.array(F.struct("path", "v", F.lit(True).alias("leaf"))).cast(_CHILD)
    return F.when(F.col("leaf"), itself).otherwise(F.coalesce(of_object.cast(_CHILD), of_array.cast(_CHILD), F.when(F.schema_of_variant("v") == "STRING", itself)))


def flatten_json(rows: DataFrame, json_text: str, keep: Sequence[str]) -> DataFrame:
    """keep, path, text: every string in a JSON text, at any depth, with its path as in a.b[2].c.

    Texts of different shapes may stand side by side: each round takes LEVELS levels off all values that still nest, one
    after the other in the same tasks, and its rows are a stored table, so a round needs no more than the values it opens.
    A text that is itself a string has the path ''. Null texts and broken JSON have no leaves, nor have numbers, booleans and nulls.
    """
    level = rows.select(*keep, F.lit("").alias("path"), F.try_parse_json(F.col(json_text)).alias("v"), F.lit(False).alias("leaf")).where("v is not null")
    found = []
    while True:
        for _ in range(LEVELS):
            # a plain explode would have the children made twice, for a filter on their number
            opened = level.select(*keep, F.explode_outer(_children()).alias("child")).where("child is not null")
            level = opened.select(*keep, "child.path", "child.v", "child.leaf")
        level = stored(level, "level")
        found.append(level.where("leaf").select(*keep, "path", F.col("v").try_cast("string").alias("text")))
        level = level.where("not leaf")
        if not level.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
