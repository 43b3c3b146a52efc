"""Running values over groups of any size: sums, maxima, bits and last values of all earlier rows.

A group of up to MOST rows is one window. Larger ones are dealt over many tasks by range of their order and written once;
each chunk gives its total, the totals of a group's chunks run over the chunks (a few rows), and every row takes what its
chunk's own earlier rows and all earlier chunks give. No task holds a group that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Rows of a group from which it is dealt over many tasks.
MOST = 1_000_000
_OVER = {"sum": F.sum, "max": F.max, "or": F.bit_or, "last": lambda v: F.last(v, ignorenulls=True)}


def combined(how: str, before: Column, after: Column) -> Column:
    """The value over two stretches of rows of which either may have none (null)."""
    if how == "sum":
        return F.coalesce(before + after, before, after)
    if how == "or":
        return F.coalesce(before.bitwiseOR(after), before, after)
    return F.greatest(before, after) if how == "max" else F.coalesce(after, before)


def running(rows: DataFrame, group: list[str], order: list[str], most: int = MOST, **values: tuple[str, Column]) -> DataFrame:
    """rows with a column for each of values, (how, column): its sum, max, bitwise or, or last non-null value over all
    earlier rows of the group; null if there are none.

    Rows of equal order count in any order among them, so order should be unique in its group. Groups are counted
    first, in a job of its own. Groups of a null key are one window, whatever their size.
    """
    own = rows.withColumns({f"_v_{n}": v for n, (_, v) in values.items()})

    def windowed(df: DataFrame, *chunk: str) -> DataFrame:
        w = Window.partitionBy(*group, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: _OVER[how](f"_v_{n}").over(w) for n, (how, _) in values.items()})

    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    n = large.agg(F.sum("_rows")).first()[0]
    drop = [f"_v_{name}" for name in values]
    if not n:
        return windowed(own).drop(*drop)
    keys = large.select(*group)
    path = scratch_path(rows.sparkSession, "chunks")
    dealt = own.join(keys, group, "left_semi").repartitionByRange(2 * n // most + 1, *group, *order)
    dealt.withColumn("_chunk", F.spark_partition_id()).write.parquet(path)  # chunks stay as they are from here on
    dealt = rows.sparkSession.read.parquet(path)
    last = F.struct(*order)
    total = {"last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), last))}
    totals = dealt.groupBy(*group, "_chunk").agg(*[total.get(how, _OVER[how])(f"_v_{name}").alias(f"_v_{name}") for name, (how, _) in values.items()])
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "_chunk", *[_OVER[how](f"_v_{name}").over(before).alias(f"_c_{name}") for name, (how, _) in values.items()])
    whole = windowed(dealt, "_chunk").join(carried, [*group, "_chunk"])
    whole = whole.withColumns({name: combined(how, F.col(f"_c_{name}"), F.col(name)) for name, (how, _) in values.items()})
    small = windowed(own.join(keys, group, "left_anti")).drop(*drop)
    return small.unionByName(whole.select(*small.columns))
