"""Order-dependent work on groups of any size: rows are dealt by ranges of (group, order), so that one group may fill many tasks.

A dealt row knows its range (`__p`) and its place in it (`__i`); both ascend with the order. What runs over a whole group is worked out
in each range and carried from range to range by a table of one row for each group and range. Folds whose state is one
of a few are made from every state at once, in segments, and the segments' tables are put together FAN at a time.

Dealing by ranges reads its input twice and keeps it once, so only groups of more than GROUP rows are dealt so (`apart`); all others are dealt
by their keys, once, and what runs over them is a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlens.sources.shared import kept

#: Rows that one fold takes as a list, and tables that are put together at once.
SEGMENT, FAN = 10_000, 32
#: Rows up to which a group is one task's work.
GROUP = 1_000_000
_PLACES = 33


def apart(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """`rows` of groups of up to GROUP rows, and those of larger groups (None if there are none)."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > GROUP).select(*keys)
    # A row for each group of more than GROUP rows.
    found = large.limit(1).count()
    if not found:
        return rows, None
    large = kept(large)
    same = F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys))
    sides = [rows.alias("l").join(F.broadcast(large).alias("r"), same, how) for how in ("left_anti", "left_semi")]
    return sides[0], sides[1]


def each_way(rows: DataFrame, keys: list[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `small` makes of the groups of up to GROUP rows, and `large` of the others."""
    few, many = apart(rows, keys)
    return small(few) if many is None else small(few).unionByName(large(many))


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` sorted by `keys` and `order` (which tells all rows of a group apart) in ranges, kept, with `__p` and `__i`."""
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND((1 << _PLACES) - 1)
    return kept(ranged.withColumns({"__p": F.shiftright("__id", _PLACES).cast("int"), "__i": place}).drop("__id"))


def _same(left: DataFrame, keys: list[str]) -> Column:
    return F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in [*keys, "__p"]))


def _with_range_facts(rows: DataFrame, facts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """`rows` with columns of the table that has a row for each group and range."""
    joined = rows.alias("l").join(facts.alias("r"), _same(rows, keys), "left")
    return joined.select("l.*", *[F.col(f"r.{n}") for n in names])


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Dealt `rows` with the sum of `value` from the start of the group up to and with each row."""
    local = F.sum("__value").over(Window.partitionBy(*keys, "__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("__value", value.cast("bigint")).withColumn("__local", local)
    totals = rows.groupBy(*keys, "__p").agg(F.sum(value.cast("bigint")).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    facts = totals.withColumn("__before", before)
    found = _with_range_facts(summed, facts, keys, ["__before"])
    return found.withColumn(name, F.coalesce("__local", F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("__value", "__local", "__before")


def before(rows: DataFrame, keys: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Dealt `rows` with the values that `columns` have in the group's row before (null in its first row)."""
    local = Window.partitionBy(*keys, "__p").orderBy("__i")
    here = F.lag(F.struct(*columns)).over(local)
    last = rows.groupBy(*keys, "__p").agg(F.max_by(F.struct(*columns), F.col("__i")).alias("__last"))
    facts = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__p"))).drop("__last")
    found = _with_range_facts(rows.withColumn("__here", here), facts, keys, ["__carried"])
    both = F.coalesce("__here", "__carried")
    return found.select("*", *[both[c].alias(f"{prefix}{c}") for c in columns]).drop("__here", "__carried")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once: an expression named inside a function over arrays would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segment_lists(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, __p, __s, __rows: the `fields` of dealt rows in order, SEGMENT at most in a list."""
    segment = F.floor(F.col("__i") / SEGMENT)
    listed = F.array_sort(F.collect_list(F.struct(F.col("__i"), *fields)))
    return rows.groupBy(*keys, "__p", segment.alias("__s")).agg(listed.alias("__rows"))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of groups that are one task's, with `__p` (0) and `__i` (their places in the group) as `dealt` gives them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumns({"__p": F.lit(0), "__i": place})


def chained(tables: DataFrame, keys: list[str], after: Callable[[Column, Column], Column]) -> DataFrame:
    """`composed` for groups that are one task's."""
    listed = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__s").alias("k"), F.col("__to").alias("to")))).alias("__l"))
    rest = F.slice("__l", F.lit(2), F.greatest(F.size("__l"), F.lit(1)))
    return listed.select(*keys, F.aggregate(rest, F.get("__l", F.lit(0))["to"], lambda a, b: after(a, b["to"])).alias("__to"))


def composed(tables: DataFrame, keys: list[str], after: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, __to: the tables (__to) of a group's segments put together; `after(first, second)` is the table of one segment followed by another."""
    tables = kept(tables.select(*keys, "__p", "__s", "__to"))
    most = tables.agg(F.max("__s").alias("s"), F.max("__p").alias("p")).first()

    def rounds(tables: DataFrame, by: str, rest: list[str], most: int) -> DataFrame:
        while most > 0:
            listed = tables.groupBy(*keys, *rest, F.floor(F.col(by) / FAN).alias(by)).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col("__to").alias("to")))).alias("__l"))
            whole = F.aggregate(F.slice("__l", F.lit(2), F.lit(FAN)), F.get("__l", F.lit(0))["to"], lambda a, b: after(a, b["to"]))
            tables, most = listed.select(*keys, *rest, by, whole.alias("__to")), most // FAN
        return tables

    tables = rounds(tables, "__s", ["__p"], most["s"] or 0)
    return rounds(tables, "__p", [], most["p"] or 0).select(*keys, "__to")
