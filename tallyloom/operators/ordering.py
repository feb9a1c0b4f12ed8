"""The sort of a table as its reader clicks it: numbers by number, everything else as text in the order of a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def next_sort(key: str | None, direction: str | None, clicked: str, sortable: bool = True) -> tuple[str | None, str | None]:
    """What a click on a column's head makes of the sort: falling, then rising, then none; another column begins anew."""
    if not sortable:
        return key, direction
    if key != clicked:
        return clicked, "desc"
    return (key, "asc") if direction == "desc" else (None, None)


def sort_columns(df: DataFrame, key: str, direction: str, *ties: str, collation: str = "UNICODE") -> list[Column]:
    """Order of rows by a column; nulls last either way; ties: columns that decide, rising, among equals."""
    value = F.col(key) if isinstance(df.schema[key].dataType, NumericType) else F.collate(F.col(key).cast("string"), collation)
    return [value.asc_nulls_last() if direction == "asc" else value.desc_nulls_last(), *map(F.asc, ties)]


def sort_table(df: DataFrame, key: str | None, direction: str | None, *ties: str, collation: str = "UNICODE") -> DataFrame:
    """df in that order, all rows, dealt by range; as it is without a key or a direction."""
    return df if key is None or direction is None else df.orderBy(*sort_columns(df, key, direction, *ties, collation=collation))
