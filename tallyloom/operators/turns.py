"""Validation and dedup of API-call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_reason(now: str):
    """Why a record is no turn, the first reason that holds, or null. now: the latest time allowed."""
    total = sum((F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_creation", "cache_read")), F.lit(0))
    return (
        F.when(~F.col("is_agent") & F.coalesce(F.col("is_sidechain"), F.lit(False)), "sidechain")
        .when(F.col("model") == "<synthetic>", "synthetic")
        .when(F.col("model").isNull() | (total == 0) | F.col("ts").isNull() | (F.col("ts") > F.lit(now).cast("timestamp")), "invalid")
    )


def request_key() -> Column:
    """A request's key within its file. Records without an id get keys of their own, so they spread over the partitions instead of meeting in one."""
    return F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.concat(F.lit("\u0000"), F.col("line_pos").cast("string")))


def last_of_request(records: DataFrame) -> DataFrame:
    """Within a file the last record of a request, at the place of its first; records without a request id all stay.

    An aggregate, so that each task sends one row a request and not its records.
    """
    names = [c for c in records.columns if c not in ("session_id", "file_id", "line_pos")]
    last = F.max_by(F.struct(*names), "line_pos").alias("last")
    once = records.groupBy("session_id", "file_id", request_key().alias("k")).agg(last, F.min("line_pos").alias("line_pos"))
    return once.select("session_id", "file_id", "last.*", "line_pos").select(*records.columns)


def collected_of_request(records: DataFrame) -> DataFrame:
    """last_of_request() with the tool names of all of a request's records, in their order: streamed responses may name each tool in a record of its own."""
    names = records.where(F.nullif(F.col("request_id"), F.lit("")).isNotNull()).select("session_id", "file_id", "request_id", F.posexplode("tool_names").alias("at", "tool"), "line_pos")
    # A tool that a later record names again is the same use: the largest count in one record holds.
    counted = names.groupBy("session_id", "file_id", "request_id", "line_pos", "tool").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    most = counted.groupBy("session_id", "file_id", "request_id", "tool").agg(F.max("n").alias("n"), F.min(F.struct("line_pos", "at")).alias("first"))
    listed = most.groupBy("session_id", "file_id", "request_id").agg(F.array_sort(F.collect_list(F.struct("first", "tool", "n"))).alias("x"))
    all_names = F.flatten(F.transform("x", lambda x: F.array_repeat(x["tool"], x["n"].cast("int"))))
    named = listed.select("session_id", "file_id", "request_id", all_names.alias("all_names"))
    once = last_of_request(records)
    out = once.join(named, ["session_id", "file_id", "request_id"], "left")
    return out.withColumn("tool_names", F.coalesce("all_names", "tool_names")).select(*once.columns)


def without_repeats_of_main(turns: DataFrame) -> DataFrame:
    """Agent turns whose request is also in the session's main file go; those without an id (null) stay, empty ids are matched like any other."""
    main = turns.where(~F.col("is_agent")).select("session_id", "request_id").distinct().withColumn("is_agent", F.lit(True))
    return turns.join(main, ["session_id", "request_id", "is_agent"], "left_anti").select(*turns.columns)


def requests(records: DataFrame) -> DataFrame:
    """last_of_request() and without_repeats_of_main() in one pass over records with their skip_reason.

    One row a request of a file and one a record that is no turn: kept tells the turns, named is the least project
    of the records behind a row. Whether the main file holds an agent's request is told by a window over the request.
    """
    names = [c for c in records.columns if c not in ("session_id", "file_id", "line_pos")]
    valid = F.col("skip_reason").isNull()
    key = F.when(valid, request_key()).otherwise(F.concat(F.lit("\u0001"), F.col("line_pos").cast("string")))
    once = records.groupBy("session_id", "file_id", key.alias("k")).agg(F.max_by(F.struct(*names), "line_pos").alias("last"), F.min("line_pos").alias("line_pos"), F.min("project").alias("named"))
    once = once.select("session_id", "file_id", "k", "last.*", "line_pos", "named")
    shared = F.when(valid & F.col("request_id").isNotNull(), F.concat(F.lit("r"), F.col("request_id"))).otherwise(F.concat_ws("\u0000", "file_id", "k"))
    in_main = F.max(valid & ~F.col("is_agent")).over(Window.partitionBy("session_id", "shared"))
    once = once.withColumn("shared", shared).withColumn("in_main", in_main)
    kept = valid & ~(F.col("is_agent") & F.col("in_main") & F.col("request_id").isNotNull())
    return once.withColumn("kept", kept).drop("k", "shared", "in_main", "skip_reason")
