"""Token budgets: prefixes that fit, and greedy bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def within_budget(df: DataFrame, tokens: str, budget: int | Column, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """The longest prefix of each group in order whose sum of tokens + 1 is at most budget; none for a budget of 0 or less.

    Costs are positive, so the running sum grows and a filter finds the prefix. Without `by` all rows
    are one group: give it few rows, such as a top-k.
    """
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return df.withColumn("__used", F.sum(F.col(tokens) + 1).over(window)).where((F.col("__used") <= limit) & (limit > 0)).drop("__used")


def greedy_bins(df: DataFrame, item: str, tokens: str, budget: int, order: list[str], by: list[str]) -> DataFrame:
    """(by..., item, bin): consecutive bins of each group whose sums of tokens + 1 are at most budget; an item over the budget is a bin of its own.

    A fold over the ordered list of a group, which the caller has limited to what one answer considers.
    """
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__item"), (F.col(tokens) + 1).alias("__cost")))).alias("__rows"))
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("bins"))

    def add(acc: Column, row: Column) -> Column:
        cost = row["__cost"].cast("long")
        fresh = (acc["used"] > 0) & (acc["used"] + cost > budget)
        bin_ = F.when(fresh, acc["bin"] + 1).otherwise(acc["bin"])
        return F.struct(bin_.alias("bin"), F.when(fresh, cost).otherwise(acc["used"] + cost).alias("used"), F.concat(acc["bins"], F.array(bin_)).alias("bins"))

    bins = F.aggregate("__rows", start, add, lambda acc: acc["bins"])
    zipped = rows.select(*by, F.explode(F.arrays_zip(F.col("__rows.__item").alias("item"), bins.alias("bin"))).alias("z"))
    return zipped.select(*by, F.col("z.item").alias(item), F.col("z.bin").alias("bin"))
