"""Queries by name over turn rows and conversations. Their SQL, in oracles.py, is written apart from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pricing import priced, resolve
from ..functions.scalars import project_display_name, short_model, strip_bracket
from ..operators.graph import bucketed, chain_lengths
from ..operators.scan import carry_last, running_sum
from ..operators.turns import last_of_request, requests, skip_reason, without_repeats_of_main
from ..sources.adapters import calendar, raw_turns_from_events
from .oracles import NOW, SQL, TODAY
from .payloads import PAYLOADS
from .reports import REPORTS, Facts, distribution


def for_reports(kept: DataFrame, timezone: str | None = None) -> DataFrame:
    """Turns with their prices, calendar columns (of a time zone, else the session's) and display names."""
    return calendar(priced(kept), timezone).withColumns({"display": project_display_name(F.col("project")), "bare_model": strip_bracket(F.col("model")), "short": short_model(F.col("model"))})


def validated(raw: DataFrame) -> DataFrame:
    return raw.withColumn("skip_reason", skip_reason(NOW)).where("skip_reason is null").drop("skip_reason", "is_sidechain")


def facts(raw: DataFrame, today: str = TODAY) -> Facts:
    """Validated, deduplicated and priced turns, and all sessions that the records name."""
    base = for_reports(requests(raw.withColumn("skip_reason", skip_reason(NOW)).drop("is_sidechain")))
    return Facts(base.where("kept").drop("kept", "named"), raw.groupBy("session_id").agg(F.min("project").alias("project")), today, base)


def tree_report(name: str, kept: DataFrame, sessions: DataFrame | None = None, today: str = TODAY, timezone: str | None = None) -> DataFrame:
    """A report over the turns, and if given the sessions, of a transcript tree, where a turn's project is its session's, whatever folder an agent's file is in."""
    own = kept.groupBy("session_id").agg(F.min("project").alias("project")) if sessions is None else sessions.select("session_id", "project")
    kept = kept.drop("project").join(own, "session_id", "left")
    return REPORTS[name](Facts(for_reports(kept, timezone), own, today))


def _report(f):
    return lambda spark, sf_dir: f(facts(raw_turns_from_events(spark, sf_dir)))


def price_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(raw_turns_from_events(spark, sf_dir))


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, records once a request, and turns left after the cross-file dedup, for each project."""
    raw = raw_turns_from_events(spark, sf_dir)
    once = last_of_request(validated(raw))
    kept = without_repeats_of_main(once)
    tagged = [d.select("project", F.lit(k).alias("stage")) for k, d in enumerate((raw, once, kept))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("project").agg(*(F.count_if(F.col("stage") == k).alias(n) for k, n in enumerate(("records", "requests", "turns"))))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_turns_from_events(spark, sf_dir).groupBy(F.coalesce(skip_reason(NOW), F.lit("turn")).alias("reason")).agg(F.count("*").alias("records"))


def shared_request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a session's main file and one of its agents both hold."""
    once = last_of_request(validated(raw_turns_from_events(spark, sf_dir))).where("request_id <> ''")
    main, agent = (once.where(c).select("session_id", "request_id") for c in ("not is_agent", "is_agent"))
    return main.intersect(agent)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: Turns of a conversation that a task scans as one block.
BLOCK_TURNS = 256


def _block() -> Column:
    return F.floor(F.col("turn") / BLOCK_TURNS)


def last_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("text"))
    c = carry_last(conversations(spark, sf_dir), ["conv_id"], _block(), "turn", said, "t")
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.col("t")).alias("user_text"))


def autonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("entries"), F.count_if(F.col("role") == "assistant").alias("turns"), F.count_if(F.col("role") == "user").alias("prompts"))
    return c.withColumn("autonomy", F.when(F.col("prompts") == 0, F.lit(0.0)).otherwise(F.col("turns") / F.col("prompts")))


def entry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).groupBy(F.col("role").alias("entry_type")).agg(F.count("*").alias("entries"))
    return c.withColumn("percent", F.col("entries") * 1e2 / F.sum("entries").over(Window.partitionBy()))  # a row for each type


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, uuid, parent, ts) of the reply graph: each turn answers the one before."""
    c = conversations(spark, sf_dir).select("conv_id", "turn").distinct()
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("uuid"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.col("turn").alias("ts"), "conv_id")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = conversation_nodes(spark, sf_dir)
    known = n.select("session", F.col("uuid").alias("parent"), F.lit(True).alias("known"))
    j = n.join(known, ["session", "parent"], "left")
    return j.groupBy("conv_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphans"))


def longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_lengths(conversation_nodes(spark, sf_dir)).groupBy(F.col("session").cast("long").alias("conv_id")).agg(F.max("length").alias("longest"))


def chain_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by the length of their longest chain."""
    return bucketed(longest_chain(spark, sf_dir), "longest").select("bucket", "n")


def root_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_stats(spark, sf_dir).groupBy("roots").agg(F.count("*").alias("sessions"))


def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, sessions, low, median, p90, p99, high, total, mean) of nodes, roots and longest chain of a conversation."""
    stats, longest = graph_stats(spark, sf_dir), longest_chain(spark, sf_dir)
    kinds = {"nodes": stats.select(F.col("nodes").alias("v")), "roots": stats.select(F.col("roots").alias("v")), "longest": longest.select(F.col("longest").alias("v"))}
    out = None
    for kind, values in kinds.items():
        one = distribution(values.groupBy("v").agg(F.count("*").alias("n")), "v").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def response_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = running_sum(conversations(spark, sf_dir), ["conv_id"], _block(), "turn", (F.coalesce(F.col("role"), F.lit("")) != "assistant").cast("int"), "grp")
    return c.where("role = 'assistant'").groupBy("conv_id", "grp").agg(F.count("*").alias("entries"), F.min("turn").alias("first_turn"))


QUERIES = {name: _report(f) for name, f in (REPORTS | PAYLOADS).items()} | {
    "j01_price_resolution": price_resolution,
    "j03_dedup_counts": dedup_counts,
    "f01_skip_reasons": skip_reasons,
    "u03_shared_request_ids": shared_request_ids,
    "j13_last_user_text": last_user_text,
    "a34_autonomy": autonomy,
    "a47_entry_types": entry_types,
    "a45_graph_stats": graph_stats,
    "a46_chain_buckets": chain_buckets,
    "a46_root_histogram": root_histogram,
    "a46_graph_sizes": graph_sizes,
    "g01_longest_chain": longest_chain,
    "g03_response_groups": response_groups,
}
ORACLE_SQL = dict(SQL)
