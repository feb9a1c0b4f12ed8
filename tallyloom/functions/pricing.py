"""Longest-prefix prices, in whole nano-dollars a token so that sums are exact in any order."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefixes import longest_prefix
from .scalars import strip_bracket

# Thousandths of a dollar for a million tokens (nano-dollars a token):
# input, cache write 5 minutes, cache write 1 hour, cache read, output.
PRICES = (
    ("claude-opus-4-8", 5000, 6250, 10000, 500, 25000),
    ("claude-opus-4-7", 5000, 6250, 10000, 500, 25000),
    ("claude-opus-4-6", 5000, 6250, 10000, 500, 25000),
    ("claude-opus-4-5", 5000, 6250, 10000, 500, 25000),
    ("claude-opus-4-1", 15000, 18750, 30000, 1500, 75000),
    ("claude-opus-4", 15000, 18750, 30000, 1500, 75000),
    ("claude-sonnet-4-6", 3000, 3750, 6000, 300, 15000),
    ("claude-sonnet-4-5", 3000, 3750, 6000, 300, 15000),
    ("claude-sonnet-4", 3000, 3750, 6000, 300, 15000),
    ("claude-haiku-4-5", 1000, 1250, 2000, 100, 5000),
    ("claude-haiku-3-5", 800, 1000, 1600, 80, 4000),
    ("claude-3-haiku", 250, 300, 500, 30, 1250),
)
FALLBACK = "claude-opus-4-8"
RATES = ("r_input", "r_5m", "r_1h", "r_read", "r_output")


#: The day on which the prices were taken, and the days after which they count as stale.
PRICED_ON, STALE_DAYS = "2026-03-21", 90


def price_of(model: Column, overrides: dict[str, tuple] | None = None) -> Column:
    """struct<price_key, source, rates> of a model: exact or longest prefix, overrides first, else the fallback.

    The table has a dozen rows, so it is a literal of the plan: a column expression, no join.
    """
    table = [(k, True, v) for k, v in sorted((overrides or {}).items(), key=lambda x: -len(x[0]))] + [(p[0], False, p[1:]) for p in sorted(PRICES, key=lambda p: -len(p[0]))]
    fields = "struct<price_key:string,source:string," + ",".join(f"{r}:bigint" for r in RATES) + ">"

    def row(key: str, source: str, rates) -> Column:
        return F.struct(F.lit(key), F.lit(source), *map(F.lit, rates)).cast(fields)

    name = strip_bracket(model)
    own = next(p[1:] for p in PRICES if p[0] == FALLBACK)
    choices = []
    for group in (True, False):
        for kind in ("exact", "prefix"):
            for key, override, rates in table:
                if override == group:
                    choices.append((name == key if kind == "exact" else F.startswith(name, F.lit(key)), row(key, ("override " if override else "") + kind, rates)))
    found = F.when(*choices[0])
    for test, value in choices[1:]:
        found = found.when(test, value)
    return found.otherwise(row(FALLBACK, "fallback", own))


#: Up to so many override prices are conditions of the plan; more are joined.
CHAIN = 64


def _joined(df: DataFrame, overrides: dict[str, tuple]) -> DataFrame:
    """df with the columns of price_of(), by a join of its models with the override table; the built-in prices stay conditions."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in overrides.items()], "o_key string, " + ", ".join(f"o_{r} long" for r in RATES))
    own = longest_prefix(df, strip_bracket(F.col("model")), table, "o_key").withColumn("p", price_of(F.col("model")))
    source = F.when(F.col("o_key") == strip_bracket(F.col("model")), "override exact").otherwise("override prefix")
    found = F.col("o_key").isNotNull()
    price = [F.coalesce("o_key", "p.price_key").alias("price_key"), F.when(found, source).otherwise(F.col("p.source")).alias("source"), *(F.when(found, F.col(f"o_{r}")).otherwise(F.col(f"p.{r}")).alias(r) for r in RATES)]
    return own.select(*df.columns, *price)


def with_prices(df: DataFrame, overrides: dict[str, tuple] | None = None) -> DataFrame:
    """df (model) with price_key, source and rates."""
    if overrides and len(overrides) > CHAIN:
        return _joined(df, overrides)
    return df.withColumn("p", price_of(F.col("model"), overrides)).select(*df.columns, "p.*")


def resolve(models: DataFrame, overrides: dict[str, tuple] | None = None) -> DataFrame:
    """(model, price_key, source, rates) of each distinct model."""
    return with_prices(models.select("model").distinct(), overrides)


def priced(turns: DataFrame, overrides: dict[str, tuple] | None = None) -> DataFrame:
    """Turns with their price and the cost of each category and their sum in nano-dollars.

    With a split by time to live only the split counts; without one all cache creation is at the 5 minute rate.
    """
    t = with_prices(turns, overrides)
    split = F.col("has_ttl")
    t = t.withColumns({
        "cost_input": F.col("input_tokens") * F.col("r_input"),
        "cost_5m": F.when(split, F.coalesce("cw_5m", F.lit(0))).otherwise(F.col("cache_creation")) * F.col("r_5m"),
        "cost_1h": F.when(split, F.coalesce("cw_1h", F.lit(0))).otherwise(F.lit(0)) * F.col("r_1h"),
        "cost_read": F.col("cache_read") * F.col("r_read"),
        "cost_output": F.col("output_tokens") * F.col("r_output"),
    })
    return t.withColumn("cost", F.col("cost_input") + F.col("cost_5m") + F.col("cost_1h") + F.col("cost_read") + F.col("cost_output"))


def price_age(today: Column) -> tuple[Column, Column]:
    """Days since the prices were taken, and whether they are stale."""
    days = F.datediff(today, F.lit(PRICED_ON).cast("date"))
    return days, days > STALE_DAYS


def load_config(text: str) -> tuple[list[dict], dict[str, tuple]]:
    """Subscriptions, and price overrides for priced(), of a TOML configuration: dollars for a million tokens become nano-dollars a token."""
    found = tomllib.loads(text)
    rates = ("base_input", "cache_write_5m", "cache_write_1h", "cache_read", "output")
    own = {model: tuple(round(float(v[r]) * 1000) for r in rates) for model, v in found.get("pricing_override", {}).items()}
    return list(found.get("subscription", [])), own
