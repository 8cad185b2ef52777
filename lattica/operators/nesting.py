"""Nesting: which openers enclose a row, by running depth or by indentation.

A row at depth d lies inside one opener of each shallower level at most: the last one
before it. So a row asks each level below its own, and a window over (text, level) carries
the last opener along. No stack is kept, and a text's levels are sorted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_depth(change: Column, order: str, *within: str) -> Column:
    """The sum of changes of depth before each row."""
    return F.coalesce(F.sum(change).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def enclosing(rows: DataFrame, within: list[str], order: str, level: str, opener: str) -> DataFrame:
    """(within, order, path): for every row, the openers that enclose it, outermost first.

    `rows` has the columns `within`, a place `order`, a `level` from 0 and `opener`, what a
    row opens at its level, or null. An opener at a level is closed by the next row that
    opens there or at a lower level; rows at or below its own level that open nothing
    aren't inside it, by their level. An opener's own path leaves it out.
    """
    keys = [*within, order]
    opened = rows.where(F.col(opener).isNotNull()).select(*keys, F.col(level).alias("_at"), F.struct(F.col(order).alias("place"), F.col(opener).alias("what")).alias("_open"), F.lit(False).alias("_asks"))
    asked = rows.where(F.col(level) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col(level) - 1)).alias("_at"), F.lit(None).cast(opened.schema["_open"].dataType).alias("_open"), F.lit(True).alias("_asks"))
    before = Window.partitionBy(*within, "_at").orderBy(order, "_asks").rowsBetween(Window.unboundedPreceding, -1)
    met = opened.unionByName(asked).withColumn("_last", F.last("_open", ignorenulls=True).over(before)).where("_asks and _last is not null")
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("level"), F.col("_last.place").alias("place"), F.col("_last.what").alias("what")))).alias("_all"))  # as many as levels
    # One that stands before an opener of a lower level was closed by it.
    alive = F.filter("_all", lambda x, i: (i == 0) | (x["place"] > F.coalesce(F.array_max(F.transform(F.slice("_all", 1, i), lambda y: y["place"])), F.lit(-1))))
    found = listed.select(*keys, F.transform(alive, lambda x: x["what"]).alias("path"))
    kind = found.schema["path"].dataType.simpleString()
    return rows.select(*keys).join(found, keys, "left").withColumn("path", F.coalesce("path", F.array().cast(kind)))
