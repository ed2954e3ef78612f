"""Running sums and ranks over long ordered runs, in two levels so that no task sees a whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running_sum(rows: DataFrame, by: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of `value` over earlier rows (by `order`, an integer) of the same `by`.

    Rows are summed by block of the order column; blocks (a row for each `block` values) are summed in order; each
    row then adds the sum within its own block. Ties are ordered by nothing, so `order` should be unique in `by`.
    """
    dealt = rows.withColumn("__block", F.floor(F.col(order) / block))
    sums = dealt.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    level = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(level.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    own = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(before, [*by, "__block"]).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__block", "__before")


def rank(rows: DataFrame, by: list[str], order: str, name: str = "rank", block: int = BLOCK) -> DataFrame:
    """rows with their 1-based rank by `order`."""
    one = rows.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sum(one, by, order, "__one", name, block).withColumn(name, F.col(name) + 1).drop("__one")
