"""Turn rows from the events table, or from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(turns: DataFrame, timezone: str | None = None) -> DataFrame:
    """Day, hour and weekday (Monday 0) columns of ts in a time zone (else the session's), and the context size."""
    at = F.col("ts") if timezone is None else F.convert_timezone(F.current_timezone(), F.lit(timezone), F.col("ts").cast("timestamp_ntz"))
    return turns.withColumns({
        "day": F.date_format(at, "yyyy-MM-dd"),
        "hour": F.hour(at),
        "dow": F.weekday(at),
        "context": F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read"),
    })


def raw_turns_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API-call record an event, before validation and dedup."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    cc = n * 104729 % 5000
    agent = n % 4 == 0
    return e.select(
        F.concat(F.lit("s"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.concat(F.lit("-Users-dev-proj"), (F.col("user_id") % 12).cast("string")).alias("project"),
        F.when(n % 41 == 0, "<synthetic>").otherwise(F.expr("case event_type when 'purchase' then 'claude-opus-4-6' when 'signup' then 'claude-sonnet-4-5-20250929' when 'view' then 'claude-haiku-4-5' when 'click' then 'claude-opus-4-8[1m]' else 'claude-future-x-1' end")).alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.floor(F.col("value") * 100).cast("long"), F.lit(0)).alias("output_tokens"),
        cc.alias("cache_creation"),
        (n * 7919 % 50000).alias("cache_read"),
        (n % 3 != 0).alias("has_ttl"),
        (cc - F.floor(cc / 4)).alias("cw_5m"),
        F.floor(cc / 4).alias("cw_1h"),
        agent.alias("is_agent"),
        F.when(agent, n % 7).otherwise(F.lit(-1)).cast("long").alias("file_id"),
        F.when(n % 11 != 0, F.concat(F.lit("r"), (F.floor(n / 50) * 50).cast("string"))).alias("request_id"),
        F.expr("case event_id % 4 when 0 then 'tool_use' when 1 then 'end_turn' when 2 then 'max_tokens' else 'stop_sequence' end").alias("stop_reason"),
        F.expr("case event_id % 5 when 0 then array('Bash') when 1 then array('Edit', 'Bash') when 2 then array('Read') else array() end").cast("array<string>").alias("tool_names"),
        F.when(n % 6 == 0, "").when(n % 2 == 0, "main").otherwise("dev").alias("git_branch"),
        F.when(n % 9 == 0, "toolkit").when(n % 9 == 1, "").alias("plugin"),
        F.when(n % 10 == 0, "review").when(n % 10 == 3, "").alias("skill"),
        F.when(agent, F.concat(F.lit("a"), (n % 7).cast("string"))).alias("entry_agent_id"),
        F.when(n % 4 == 1, "priority").when(n % 4 == 2, "standard").alias("service_tier"),
        F.when(n % 3 == 1, "fast").otherwise("").alias("speed"),
        F.when(n % 5 == 2, "us").alias("inference_geo"),
        (n % 37 == 0).alias("is_sidechain"),
        n.alias("line_pos"),
    )


def raw_turns_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a line item: a session an order, a project for every twelfth customer. The larger input, for measuring."""
    i, o = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    j, line = i.join(o, i.l_orderkey == o.o_orderkey), F.col("l_linenumber").cast("long")
    n = F.col("l_orderkey") * 8 + line
    agent = line % 4 == 0
    return j.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("session_id"),
        F.concat(F.lit("-Users-dev-proj"), (F.col("o_custkey") % 12).cast("string")).alias("project"),
        F.expr("case l_returnflag when 'A' then 'claude-opus-4-6' when 'N' then 'claude-sonnet-4-5-20250929' else 'claude-haiku-4-5' end").alias("model"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").alias("input_tokens"),
        F.floor("l_extendedprice").cast("long").alias("output_tokens"),
        (F.col("l_suppkey") * 10).alias("cache_creation"),
        F.floor(F.col("l_quantity") * 1000).cast("long").alias("cache_read"),
        F.lit(False).alias("has_ttl"),
        F.lit(0).cast("long").alias("cw_5m"),
        F.lit(0).cast("long").alias("cw_1h"),
        agent.alias("is_agent"),
        F.when(agent, line).otherwise(F.lit(-1)).alias("file_id"),
        F.concat(F.lit("r"), n.cast("string")).alias("request_id"),
        F.lit("end_turn").alias("stop_reason"),
        F.array(F.col("l_linestatus")).alias("tool_names"),
        *(F.lit("").alias(c) for c in ("git_branch", "plugin", "skill", "entry_agent_id", "service_tier", "speed", "inference_geo")),
        F.lit(False).alias("is_sidechain"),
        n.alias("line_pos"),
    )
