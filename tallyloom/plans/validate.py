"""Checks of a transcript tree: the pipeline's figures against a recount that reads the raw lines on its own.

The recount takes every field by its path from the parsed JSON (variant), never from the pipeline's typed records, so
a mistake in the one is not in the other. Both are aggregated by file or session and then joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pricing import priced
from ..sources import transcripts as T
from ..sources.shapes import field

COUNTERS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_input_tokens": "cache_creation_tokens", "cache_read_input_tokens": "cache_read_tokens"}


def raw_records(spark: SparkSession, home: str, now: str) -> DataFrame:
    """(path, rid, n, counters) of the lines that are valid API calls: the last of each request in a file, and each line without one."""
    v = T.lines(spark, home).select("path", "line_pos", F.try_parse_json("value").alias("v"))
    counts = {name: F.coalesce(F.when(field(f"message.usage.{wire}", "bigint") >= 0, field(f"message.usage.{wire}", "bigint")), F.lit(0)) for wire, name in COUNTERS.items()}
    at = F.when(F.rlike(field("timestamp"), F.lit(T.RFC3339)), F.try_to_timestamp(field("timestamp")))
    total = reduce(Column.__add__, counts.values())
    side = F.coalesce(field("isSidechain", "boolean"), F.lit(False)) & ~F.rlike("path", F.lit(r"/agent-[^/]*\.jsonl$"))
    valid = (field("type") == "assistant") & ~side & (field("message.model") != "<synthetic>") & field("message.usage", "variant").isNotNull() & (total > 0) & (at <= F.lit(now).cast("timestamp"))
    rid = F.nullif(field("requestId"), F.lit(""))
    rows = v.where(valid).select("path", "line_pos", rid.alias("rid"), *(c.alias(n) for n, c in counts.items()))
    key = F.coalesce("rid", F.concat(F.lit("\u0000"), F.to_json("line_pos")))
    last = F.row_number().over(Window.partitionBy("path", "key").orderBy(F.desc("line_pos")))
    return rows.withColumn("key", key).withColumn("rn", last).where("rn = 1").drop("rn", "key", "line_pos")


def check(name: Column | str, expected: Column, actual: Column, passed: Column | None = None) -> Column:
    """A check's row: it passes if both read the same, or as given."""
    e, a = expected.cast("string"), actual.cast("string")
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), e.alias("expected"), a.alias("actual"), F.coalesce(e.eqNullSafe(a) if passed is None else passed, F.lit(False)).alias("passed"))


def informational(name: str, value: Column) -> Column:
    return check(name, value, value)


def _rows(df: DataFrame, kind: str, *checks: Column) -> DataFrame:
    """One row a check; null checks do not apply."""
    session = F.col("session_id") if "session_id" in df.columns else F.lit(None).cast("string")
    return df.select(session.alias("session_id"), F.lit(kind).alias("kind"), F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("session_id", "kind", "c.*")


def checks(spark: SparkSession, home: str, now: str, prefix: str = "", pipeline_turns: DataFrame | None = None) -> DataFrame:
    """(session_id, kind, name, expected, actual, passed): structure checks (session_id null), and those of every session that begins with prefix.

    pipeline_turns: the turns under test, those of the pipeline if not given.
    """
    files = T.files(spark, home)
    entries = T.entries(spark, home)
    turns = (T.turns(T.records(entries, now)) if pipeline_turns is None else pipeline_turns).where(F.startswith("session_id", F.lit(prefix)))
    sessions = T.sessions(files, turns).where(F.startswith("session_id", F.lit(prefix)))
    raw = raw_records(spark, home, now).join(files.select("path", "session_id", "is_agent"), "path")
    main_ids = raw.where("not is_agent and rid is not null").select("session_id", "rid").distinct().withColumn("shared", F.lit(True))
    agents = raw.where("is_agent").join(main_ids, ["session_id", "rid"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))

    # Structure.
    f = files.agg(F.count_if(~F.col("is_agent")).alias("main"), F.count_if("is_agent").alias("agent"), F.count_distinct(F.when(~F.col("is_agent"), F.col("session_id"))).alias("ids"))
    listed = T.sessions(files, turns.limit(0)).agg(F.count_if(~F.col("is_orphan")).alias("sessions"), F.coalesce(F.sum("agent_files"), F.lit(0)).alias("agent_files"), F.coalesce(F.sum(F.when(F.col("is_orphan"), F.col("agent_files"))), F.lit(0)).alias("orphans"))
    overlap = agents.where("shared").select("path", "rid").distinct().agg(F.count("*").alias("overlap"))
    s = f.crossJoin(listed).crossJoin(overlap)  # one row each
    structure = _rows(s, "structure", check("session_count == main_file_count", F.col("ids"), F.col("sessions")), check("agent_file_count", F.col("agent"), F.col("agent_files")), informational("orphan_agents", F.col("orphans")), informational("main_session_files", F.col("main")), informational("cross_file_overlapping_request_ids", F.col("overlap")))

    # Recount and pipeline by session.
    raw_main = raw.where("not is_agent").groupBy("session_id").agg(F.count("*").alias("raw_turns"), *(F.sum(n).alias(f"raw_{n}") for n in COUNTERS.values()))
    raw_agent = agents.groupBy("session_id").agg(F.count_if(~F.col("shared")).alias("raw_agent_turns"), F.coalesce(F.sum(F.when(~F.col("shared"), F.col("output_tokens"))), F.lit(0)).alias("raw_agent_output"))
    own = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_tokens": "cache_creation", "cache_read_tokens": "cache_read"}
    main = ~F.col("is_agent")
    got = priced(turns).groupBy("session_id").agg(
        F.count_if(main).alias("main_turns"), F.count_if("is_agent").alias("agent_got"), F.count("*").alias("all_turns"), *(F.coalesce(F.sum(F.when(main, F.col(c))), F.lit(0)).alias(f"got_{n}") for n, c in own.items()),
        F.coalesce(F.sum(F.when(F.col("is_agent"), F.col("output_tokens"))), F.lit(0)).alias("agent_output"), F.sum("output_tokens").alias("all_output"), F.sum("cost").alias("cost"), F.count_if((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)).alias("with_tokens"),
        F.every(F.col("is_agent") == F.rlike("path", F.lit(r"/agent-[^/]*\.jsonl$"))).alias("marked"),
    )
    project = files.where("not is_agent").groupBy("session_id").agg(F.min("project").alias("main_project"))
    b = sessions.drop("turns", "agent_turns").join(got, "session_id", "left").join(raw_main, "session_id", "left").join(raw_agent, "session_id", "left").join(project, "session_id", "left")
    b = b.fillna(0, [c for c in b.columns if c not in ("session_id", "project", "main_project", "is_orphan", "first_ts", "last_ts", "marked", "agent_files")])
    has_main, has_agents = ~F.col("is_orphan"), F.col("agent_files") > 0
    larger = F.greatest("raw_agent_output", "agent_output")
    near = (larger == 0) | (F.abs(F.col("raw_agent_output") - F.col("agent_output")) / F.nullif(larger, F.lit(0)) < 0.05)
    true = F.lit("true")
    per = _rows(
        b, "session",
        F.when(has_main, check("main_turn_count", F.col("raw_turns"), F.col("main_turns"))), *(F.when(has_main, check(f"main_{n}", F.col(f"raw_{n}"), F.col(f"got_{n}"))) for n in COUNTERS.values()),
        check("agent_file_count (from scanner)", F.col("agent_files"), F.col("agent_files")), F.when(has_agents, check("agent_turn_count (after cross-file dedup)", F.col("raw_agent_turns"), F.col("agent_got"))),
        F.when(has_agents & (F.col("raw_agent_turns") > 0), check("has_agent_turns (non-overlapping exist)", true, F.col("agent_got") > 0)), F.when(has_agents, check("agent_output_tokens (±5%)", F.col("raw_agent_output"), F.col("agent_output"), near)),
        F.when(has_agents, check("all agent_turns have is_agent=true", true, F.coalesce("marked", F.lit(True)))), check("total_turn_count == turns + agent_turns", F.col("main_turns") + F.col("agent_got"), F.col("all_turns")),
        F.when(F.col("all_turns") > 0, check("total_output_tokens > 0", true, F.col("all_output") > 0)), F.when(F.col("with_tokens") > 0, check("cost > 0 when tokens exist", true, F.col("cost") > 0)),
        F.when(has_main, check("project_association", F.coalesce("main_project", F.lit("(none)")), F.coalesce("project", F.lit("(none)")))),
    )

    # Workflow runs against their snapshots.
    w = T.workflow_runs(spark, home, T.subagents(files, turns, T.agent_meta(spark, home))).where(F.startswith("session_id", F.lit(prefix)))
    named = lambda text: F.concat(F.lit("workflow["), "run_id", F.lit(f"] {text}"))
    runs = _rows(w, "workflow", check(named("parsed tokens > 0 (no loss)"), true, F.col("tokens") > 0), F.when(F.col("snapshot_agents").isNotNull(), check(named("agent_count == snapshot"), F.col("snapshot_agents"), F.col("agents"))), F.when(F.col("snapshot_tokens").isNotNull(), check(named("snapshot.totalTokens (informational)"), F.col("tokens"), F.col("tokens"))))
    return structure.unionByName(per).unionByName(runs)


def summary(checks: DataFrame) -> DataFrame:
    """One row: checks, passed, failed, sessions validated and those without a failure."""
    per = checks.where("session_id is not null").groupBy("session_id").agg(F.every("passed").alias("passed")).agg(F.count("*").alias("sessions_validated"), F.count_if("passed").alias("sessions_passed"))
    return checks.agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")).crossJoin(per)  # one row each


def failures(checks: DataFrame) -> DataFrame:
    return checks.where("not passed")


def graph_checks(entries: DataFrame) -> DataFrame:
    """Oracles of the graph: no drift, no unreadable line, no undeclared types, no leaks, no orphans."""
    stats = T.graph_stats(T.graph_nodes(entries)).agg(F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"))
    read = entries.agg(F.count_if(F.col("status") == "drift").alias("drift"), F.count_if(F.col("status") == "json").alias("errors"))
    more = T.unknown_types(entries).agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("unknown")).crossJoin(T.leaks(entries).agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("leaks")))
    one = stats.crossJoin(read).crossJoin(more)  # one row each
    return _rows(one, "graph", *(check(n, F.lit(0), F.col(n)) for n in ("drift", "errors", "unknown", "leaks", "orphans"))).drop("session_id")
