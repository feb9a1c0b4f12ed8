"""Segmented prefix scans: what a running window over a long group says, without gathering the group in one task.

The rows of a group come in blocks (splits of a file, stretches of turns), in order. A window runs within each
block, one summary row a block is aggregated with map-side combine, a window over the summaries alone gives each
block what the blocks before it add up to, and the rows join that. A group of any length costs tasks of a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(rows: DataFrame, keys: list[str], block: Column, order: str, out: str, own: Callable, total: Column, before: Callable, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with column `out`: combine(what the group's earlier blocks carry in, what the row's own block says).

    keys: columns of the group, nulls equal; block: never falls as `order` rises, nulls first; own(window): the value
    within a block, over a window ordered by `order`; total: a block's summary, an aggregate; before(summary, window):
    the carry of the blocks before, over a window of summaries.
    """
    marked = rows.withColumn("__block", block)
    names = [*keys, "__block"]
    local = marked.withColumn("__own", own(Window.partitionBy(*names).orderBy(order)))
    sums = marked.groupBy(*names).agg(total.alias("__total"))
    carry = sums.withColumn("__carry", before(F.col("__total"), Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    # The first block of a group, mostly its only one, has nothing to carry in.
    carry = carry.where(F.col("__carry").isNotNull()).select(*(F.col(n).alias(f"__of_{k}") for k, n in enumerate(names)), "__carry")
    match = [F.col(n).eqNullSafe(F.col(f"__of_{k}")) for k, n in enumerate(names)]
    joined = local.join(carry, match, "left")
    return joined.select(*rows.columns, combine(F.col("__carry"), F.col("__own")).alias(out))


def carry_last(rows: DataFrame, keys: list[str], block: Column, order: str, value: Column, out: str) -> DataFrame:
    """rows with the last value that is not null before each row, in the order of its group."""
    named = rows.withColumn("__value", value)
    done = scan(
        named, keys, block, order, out,
        own=lambda w: F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        total=F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(order))),
        before=lambda total, w: F.last(total, ignorenulls=True).over(w),
        combine=lambda carry, own: F.coalesce(own, carry),
    )
    return done.drop("__value")


def running_sum(rows: DataFrame, keys: list[str], block: Column, order: str, value: Column, out: str) -> DataFrame:
    """rows with the sum of whole numbers up to and with each row, in the order of its group."""
    named = rows.withColumn("__value", value.cast("long"))
    done = scan(
        named, keys, block, order, out,
        own=lambda w: F.coalesce(F.sum("__value").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        total=F.sum("__value"),
        before=lambda total, w: F.sum(total).over(w),
        combine=lambda carry, own: F.coalesce(carry, F.lit(0)) + own,
    )
    return done.drop("__value")
