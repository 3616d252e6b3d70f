"""Running sums and ranks within groups of any size: no group is ever one task's.

Rows are dealt by ranges of (group, order), so a large group lies in many ranges. Each range adds up its own rows; sums of
ranges, a few rows for each, give every range the offset it starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import written

#: Rows of a range, about.
RANGE_ROWS = 500_000


def running(rows: DataFrame, group: str, order: list[str], value: Column | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `place` (1, 2, ... in the group), `so_far` (sum of value up to the row), and of the group `size`.

    order: columns that tell rows of a group apart, in ascending order, nulls first; of equal ones any comes first, and a
    hash of the row breaks what ties ranges would have. Null groups are one group; null values count 0. ranges: by default
    as many as the rows ask for.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumn("_value", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0)).withColumn("_tie", tie)
    if ranges is None:
        ranges = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    keys = [F.col(group), *[F.col(c) for c in order], F.col("_tie")]
    held = written(dealt.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = held.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))  # a row for each range of a group
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_places"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sums"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = held.withColumn("_place", F.row_number().over(inside)).withColumn("_so_far", F.sum("_value").over(inside))
    joined = own.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_places") + F.col("_place")).alias("place"), (F.col("_sums") + F.col("_so_far")).alias("so_far"), "size")


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the element in the middle, the upper of two, of each group's values. Null values are left out.

    A selection by counts: equal values are one row first, so a group is as many rows as it has different values, and the
    one that holds the middle is found by running counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_many"))
    ran = running(counts, group, [value], F.col("_many"))
    total = counts.groupBy(F.col(group).alias("_total_of")).agg(F.sum("_many").alias("_total"))
    middle = F.floor(F.col("_total") / 2)
    held = ran.join(total, F.col(group).eqNullSafe(F.col("_total_of")))
    return held.where((F.col("so_far") > middle) & (F.col("so_far") - F.col("_many") <= middle)).select(group, value)
