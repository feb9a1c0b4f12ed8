"""Longest-prefix match as a join, for tables too large for a chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(rows: DataFrame, value: Column, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of the table's row whose key is the longest prefix of value; nulls where none is.

    Each distinct value is cut once at every length that a key has and probed by equality, so the plan is of one size
    whatever the table holds, and the join is hashed. Lengths come as one row. Keys occur once; an empty key fits all.
    """
    keyed = rows.withColumn("__value", value)
    names = [c for c in table.columns if c != key]
    own = table.where(F.col(key).isNotNull()).select(F.col(key).alias("__cut"), F.struct(F.length(key).alias("length"), key, *names).alias("__row"))
    lengths = own.agg(F.sort_array(F.collect_set("__row.length")).alias("__lengths"))
    cuts = keyed.select("__value").where("__value is not null").distinct().crossJoin(lengths)  # lengths are one row
    at = F.explode(F.filter("__lengths", lambda n: n <= F.length("__value")))
    cuts = cuts.select("__value", at.alias("__n")).select("__value", F.substring(F.col("__value"), F.lit(1), F.col("__n")).alias("__cut"))
    best = cuts.join(own, "__cut").groupBy("__value").agg(F.max_by("__row", "__row.length").alias("__row"))
    return keyed.join(best, "__value", "left").select(*rows.columns, *(F.col(f"__row.{c}").alias(c) for c in (key, *names)))
