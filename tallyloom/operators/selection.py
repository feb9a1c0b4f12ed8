"""Exact order statistics by narrowing: counts a range, then only the ranges that hold the places sought."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that an interval is cut into each round; a round brings at most so many rows for each interval to the driver.
RANGES = 1024


def select_places(rows: DataFrame, value: str, places: dict[str, Callable[[int], int]], weight: str | None = None) -> dict[str, int | None]:
    """The whole number at each place (from 0) of the sorted values, exactly; None where there is no such place.

    value: a column of whole numbers, nulls left out; weight: how often a row's value counts (a column, else once).
    places: from the number of values to a place. An action, as approxQuantile is: each round counts the values of
    the open intervals by range and keeps, for every place, the one range that holds it, so 64-bit values take at
    most seven rounds whatever their number. No row is sorted, and no exchange holds more than RANGES rows for each
    place from a task.
    """
    src = rows.select(F.col(value).cast("long").alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w")).where("v is not null")
    src = src.groupBy("v").agg(F.sum("w").alias("w")).persist()  # every round reads it
    try:
        return _narrowed(src, places)
    finally:
        src.unpersist()


def _narrowed(src: DataFrame, places: dict[str, Callable[[int], int]]) -> dict[str, int | None]:
    end = src.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first()
    at = {name: int(place(end.n)) for name, place in places.items()}
    found: dict[str, int | None] = {name: None for name, p in at.items() if not 0 <= p < end.n}
    # Of each place: the interval that holds it, and how many values lie below that.
    open_at = {name: (end.low, end.high, 0) for name in at if name not in found}
    while open_at:
        for name, (low, high, _) in list(open_at.items()):
            if low == high:
                found[name] = low
                del open_at[name]
        spans = sorted({(low, high) for low, high, _ in open_at.values()})
        if not spans:
            break
        counts = {(s, r): n for s, r, n in _counts(src, spans)}
        for name, (low, high, below) in open_at.items():
            k, step = spans.index((low, high)), _step(low, high)
            for r in sorted(r for s, r in counts if s == k):
                if below + counts[k, r] > at[name]:
                    open_at[name] = (low + r * step, min(high, low + (r + 1) * step - 1), below)
                    break
                below += counts[k, r]
    return {name: found[name] for name in places}


def _step(low: int, high: int) -> int:
    return -(-(high - low + 1) // RANGES)


def _counts(src: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(span, range, values) of all ranges of the intervals that hold any; intervals are apart or the same."""
    span, place = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, (low, high) in enumerate(spans):
        inside: Column = F.col("v").between(low, high)
        # In decimals: a difference of two longs may not be a long.
        offset = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(_step(low, high)).cast("decimal(20,0)")) if high - low >= 1 << 62 else F.expr(f"(v - {low}) div {_step(low, high)}")
        span, place = F.when(inside, k).otherwise(span), F.when(inside, offset.cast("long")).otherwise(place)
    got = src.select(span.alias("s"), place.alias("r"), "w").where("s is not null").groupBy("s", "r").agg(F.sum("w").alias("n")).collect()
    return [(x.s, x.r, x.n) for x in got]
