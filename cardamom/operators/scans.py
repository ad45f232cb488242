"""Running values within groups, when a group may hold any share of the rows.

A window over a group is one task. Here rows are dealt by ranges of group and order, so that a
group may span many ranges; each range runs its own scan, the state in which it leaves its last group is
combined with those of the ranges before it by the same associative rule, and what comes in that
way is applied to the range's rows. Between ranges travels one row for each range and group in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


#: For each rule: the aggregate of a run of rows (or of states), and how a state that comes in is combined with the own one.
RULES = {
    "sum": (F.sum, lambda came, own: F.when(came.isNull(), own).when(own.isNull(), came).otherwise(came + own)),
    "max": (F.max, lambda came, own: F.greatest(came, own)),
    "min": (F.min, lambda came, own: F.least(came, own)),
    "last": (_last, lambda came, own: F.coalesce(own, came)),
}


@dataclass(frozen=True)
class Running:
    """A running value: a rule of RULES over a column; nulls take no part."""

    rule: str
    value: Column


def ranged(rows: DataFrame, by: str, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """A stored table of rows dealt by ranges of group and order, with __range and __order.

    Rows that are equal in both fall into one range, so `order` should end with something that tells rows apart.
    """
    keyed = rows.withColumn("__order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    dealt = keyed.repartitionByRange(ranges, by, "__order") if ranges else keyed.repartitionByRange(by, "__order")
    return stored(dealt.withColumn("__range", F.spark_partition_id()), "ranged")


def scan(rows: DataFrame, by: str, order: Sequence[Column | str], values: dict[str, Running], ranges: int | None = None) -> DataFrame:
    """rows with running values, each over the rows of its group up to and with the own one, in this order.

    Rows of null group are a group. A group without a value so far has null. `ranges` is the number of
    ranges that rows are dealt to (Spark's own choice unless given).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    inputs = rows.select("*", *[v.value.alias(f"__v_{name}") for name, v in values.items()])
    dealt = ranged(inputs, by, order, ranges)
    own = Window.partitionBy("__range", by).orderBy("__order").rowsBetween(*_SO_FAR)
    local = dealt.select("*", *[RULES[v.rule][0](F.col(f"__v_{name}")).over(own).alias(f"__l_{name}") for name, v in values.items()])
    # the state of a range's group is that of its last row in order
    states = [
        F.max_by(f"__v_{name}", F.when(F.col(f"__v_{name}").isNotNull(), F.col("__order"))).alias(f"__s_{name}") if v.rule == "last" else RULES[v.rule][0](F.col(f"__v_{name}")).alias(f"__s_{name}")
        for name, v in values.items()
    ]
    left = dealt.groupBy("__range", by).agg(*states)
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(*_BEFORE)
    came = left.select("__range", F.col(by).alias("__by"), *[RULES[v.rule][0](F.col(f"__s_{name}")).over(before).alias(f"__c_{name}") for name, v in values.items()])
    # only groups that span ranges have something to come in: about as many rows as ranges
    some = F.lit(False)
    for name in values:
        some = some | F.col(f"__c_{name}").isNotNull()
    came = came.where(some).withColumnRenamed("__range", "__r")
    joined = local.join(came, (F.col("__range") == F.col("__r")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.select(*rows.columns, *[RULES[v.rule][1](F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name) for name, v in values.items()])


def asof(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, take: Sequence[str], ranges: int | None = None) -> DataFrame:
    """left with the columns `take` of the last row of right, of the same group, that is not after it; nulls if there is none.

    Both sides are put in one order and the last right row is carried along. Of right rows of one time the greatest in `take` counts.
    Times or groups of null meet nothing, and right columns must be comparable.
    """
    found = F.struct(*[F.col(c) for c in take])
    a = left.select(F.col(by).alias("__owner"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("__found"), F.struct(*left.columns).alias("__row"))
    b = right.where(F.col(right_at).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("__owner"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), found.alias("__found"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.unionByName(b)
    carried = scan(both, "__owner", [F.col("__at"), F.col("__side"), F.col("__found"), F.xxhash64("__row")], {"__last": Running("last", F.col("__found"))}, ranges)
    met = F.when(F.col("__owner").isNotNull() & F.col("__at").isNotNull(), F.col("__last"))
    return carried.where("__side = 1").select(*[F.col("__row")[c].alias(c) for c in left.columns], *[met[c].alias(c) for c in take])


def segments(rows: DataFrame, by: str, order: Sequence[Column | str], starts: Column, ranges: int | None = None) -> DataFrame:
    """rows with the number of their segment: a row that starts one raises it; 0 before the first."""
    return scan(rows, by, order, {"segment": Running("sum", F.coalesce(starts, F.lit(False)).cast("long"))}, ranges)


def segment_texts(rows: DataFrame, by: str, order: str, text: Column, starts: Column, sep: str = " | ", least: int = 3, longest: int = 4000, title: int = 120, ranges: int | None = None) -> DataFrame:
    """(by, segment, title, body) of each segment that a title starts: the title cut at `title` characters, the other rows' texts joined and cut at `longest`.

    Texts of fewer than `least` characters, and null ones, aren't joined. Rows before a group's first title belong to
    that title's segment; a group without a title has none. A body's rows are gathered no further than to where it is cut,
    however many there are.
    """
    marked = segments(rows.select(by, order, text.alias("__text"), F.coalesce(starts, F.lit(False)).alias("__start")), by, [order], F.col("__start"), ranges)
    body = F.when(~F.col("__start") & (F.length("__text") >= least), F.col("__text"))
    keyed = marked.withColumn("segment", F.greatest("segment", F.lit(1))).withColumn("__key", F.struct(by, "segment")).withColumn("__body", body)
    # where a row's text begins in the body
    placed = scan(keyed, "__key", [order], {"__end": Running("sum", F.length("__body") + len(sep))}, ranges)
    begins = F.col("__end") - F.length("__body") - len(sep)
    near = placed.where(F.col("__start") | (begins < longest))
    parts = F.array_sort(F.collect_list(F.when(~F.col("__start"), F.struct(F.col(order).alias("at"), F.col("__body").alias("body")))))
    name = F.max(F.when(F.col("__start"), F.left("__text", F.lit(title))))
    joined = F.left(F.array_join(F.transform(parts, lambda p: p["body"]), sep), F.lit(longest))
    return near.groupBy(by, "segment").agg(F.bool_or("__start").alias("__titled"), name.alias("title"), joined.alias("body")).where("__titled").drop("__titled")
