"""A tree of session transcripts (JSON lines) as DataFrames: files, lines, entries, turns, and what hangs on them.

Layouts under <home>/projects: <project>/<uuid>.jsonl (main), <project>/agent-<id>.jsonl (agent of the session
that its first line names), <project>/<uuid>/subagents/agent-<id>.jsonl, and the same below
subagents/workflows/wf_<run>. Files are read as splittable text: a line's place is the start of its split and a
number that grows within it. Nothing gathers a file: the last user text is carried by a scan over its splits. A missing
folder is an empty tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pricing import priced
from ..functions.scalars import one_of, truncate_bytes
from ..operators.graph import chain_lengths
from ..operators.scan import carry_last
from ..operators.turns import last_of_request, skip_reason, without_repeats_of_main
from .shapes import field as _field
from .shapes import shape

LAYOUT = r"/projects/([^/]+)/(?:([^/]+)/subagents/(?:workflows/(wf_[^/]+)/)?)?([^/]+)\.jsonl$"
UUID = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"

# Entry types of the format.
ENTRY_TYPES = (
    "user", "assistant", "system", "attachment", "progress", "summary", "custom-title", "ai-title", "last-prompt", "task-summary", "tag", "agent-name", "agent-color", "agent-setting", "pr-link",
    "mode", "permission-mode", "queue-operation", "speculation-accept", "worktree-state", "content-replacement", "file-history-snapshot", "attribution-snapshot", "marble-origami-commit", "marble-origami-snapshot",
)

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,service_tier:string,speed:string,inference_geo:string>"
ASSISTANT = f"uuid string, parentUuid string, sessionId string, timestamp string, gitBranch string, isSidechain boolean, requestId string, agentId string, error string, attributionPlugin string, attributionSkill string, message struct<model:string,stop_reason:string,usage:{USAGE},content:array<struct<type:string,text:string,name:string,is_error:boolean>>>, _corrupt string"
META = "agentType string, description string, worktreePath string, _corrupt string"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _tree(spark: SparkSession, home: str, kind: str, pattern: str, **options) -> DataFrame | None:
    root = f"{home}/projects"
    if not _exists(spark, root):
        return None
    return spark.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup="true", **options).load(root)


def source_path() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")


def _paths(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path): every file below root whose name fits, empty ones too, which no reader returns (binaryFile neither); the driver's file index has them all."""
    found = spark.read.format("text").options(pathGlobFilter=pattern, recursiveFileLookup="true").load(root).inputFiles() if _exists(spark, root) else []
    return spark.createDataFrame([(p,) for p in found], "path string").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows of transcript files, with project, dir (the session folder), run_id, stem and is_agent."""
    d = df.withColumns({n: F.nullif(F.regexp_extract("path", LAYOUT, k + 1), F.lit("")) for k, n in enumerate(("project", "dir", "run_id", "stem"))})
    main = F.col("dir").isNull() & F.rlike("stem", F.lit(UUID))
    agent = F.startswith("stem", F.lit("agent-")) & (F.col("dir").isNull() | F.rlike("dir", F.lit(UUID)))
    return d.where(main | agent).withColumn("is_agent", ~main)


def lines(spark: SparkSession, home: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_pos, value): every line of every transcript; line_pos orders the lines of a file."""
    text = _tree(spark, home, "text", pattern, lineSep="\n")
    if text is None:
        return spark.createDataFrame([], "path string, line_pos struct<block: bigint, n: bigint>, value string")
    return text.select(source_path().alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line_pos"), "value")


#: Up to so many agent files without a session folder are broadcast to the lines; more are joined.
LOOSE = 100_000


def loose_names(spark: SparkSession, home: str) -> DataFrame:
    """(path, named): the session that the first line of an agent file without a session folder names. Reads agent files only."""
    loose = _laid_out(lines(spark, home, "agent-*.jsonl")).where("is_agent and dir is null").groupBy("path").agg(F.min_by("value", "line_pos").alias("first"))
    return loose.select("path", F.try_variant_get(F.try_parse_json("first"), "$.sessionId", "string").alias("named"))


def _with_session(df: DataFrame, named: DataFrame) -> DataFrame:
    """df with session_id: the main file's stem, an agent's folder, or what its first line names, or its own stem."""
    if named.limit(LOOSE + 1).count() <= LOOSE:
        named = F.broadcast(named)
    return df.join(named, "path", "left").withColumn("session_id", _session()).drop("named", "dir")


def _session() -> Column:
    return F.when(F.col("is_agent"), F.coalesce("dir", "named", "stem")).otherwise(F.col("stem"))


def in_sessions(files: DataFrame) -> DataFrame:
    """Rows of whole transcript files (path, named: what the first line names), with their file's columns."""
    return _laid_out(files).withColumn("session_id", _session()).drop("dir")


def files(spark: SparkSession, home: str, named: DataFrame | None = None) -> DataFrame:
    """(path, project, run_id, stem, is_agent, session_id), empty files too. named: loose_names(), if they are at hand.

    An agent without a session folder belongs to the session that its first line names, or else to itself.
    """
    found = _laid_out(_paths(spark, f"{home}/projects", "*.jsonl"))
    return _with_session(found, loose_names(spark, home) if named is None else named).select("path", "project", "run_id", "stem", "is_agent", "session_id")


def entries(spark: SparkSession, home: str, named: DataFrame | None = None) -> DataFrame:
    """Lines with their file's columns, v (variant), entry_type, status and a (the assistant fields).

    status: blank, json (malformed), drift (an assistant record of the wrong shape), ok, passthrough (an
    unknown type that carries uuid and sessionId) or ignored.
    """
    # A line's file columns come from its path; only agents without a session folder are joined, with their few names.
    return parsed(_with_session(_laid_out(lines(spark, home)), loose_names(spark, home) if named is None else named))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) with v, entry_type, a and status."""
    e = lines.withColumn("v", F.try_parse_json("value")).withColumn("entry_type", _field("type"))
    e = e.withColumn("a", F.when(F.col("entry_type") == "assistant", F.from_json("value", ASSISTANT, PERMISSIVE)))
    use = F.col("a.message.usage")
    negative = sum((F.coalesce((use[n] < 0).cast("int"), F.lit(0)) for n in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")), F.lit(0)) > 0
    drift = F.col("a._corrupt").isNotNull() | F.col("a.parentUuid").isNull() | F.col("a.message").isNull() | negative
    known = F.coalesce(F.col("entry_type").isin(*ENTRY_TYPES), F.lit(False))
    return e.withColumn(
        "status",
        F.when(F.trim("value") == "", "blank")
        .when(F.col("v").isNull(), "json")
        .when((F.col("entry_type") == "assistant") & drift, "drift")
        .when(known, "ok")
        .when((F.coalesce(_field("uuid"), F.lit("")) != "") & (F.coalesce(_field("sessionId"), F.lit("")) != ""), "passthrough")
        .otherwise("ignored"),
    )


def user_text() -> Column:
    """Text of a user entry: its content where that is a string, or its text blocks, one a line; null if there is none."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.try_variant_get("v", "$.message.content", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get("v", "$.message.content", "string"))
    return F.nullif(F.coalesce(plain, joined), F.lit(""))


def assistant_text() -> Column:
    """The text blocks of an assistant entry, one a line, at most 500 bytes."""
    texts = F.transform(F.filter(F.col("a.message.content"), lambda b: b["type"] == "text"), lambda b: b["text"])
    return truncate_bytes(F.nullif(F.array_join(texts, "\n"), F.lit("")), 503)


# Known values of fields; others are 'unknown'.
STOP_REASONS = ("end_turn", "tool_use", "stop_sequence", "refusal", "pause_turn")
TIERS, SPEEDS = ("standard", "priority", "batch"), ("standard", "fast")


def records(entries: DataFrame, now: str) -> DataFrame:
    """Assistant entries as turn rows with skip_reason (null: a turn), before any dedup, and the last user text before each in its file."""
    rows = carry_last(record_rows(entries, now), ["path"], F.col("line_pos.block"), "line_pos", F.col("said"), "user_text")
    return rows.where("entry_type = 'assistant'").drop("said", "entry_type")


def record_rows(entries: DataFrame, now: str) -> DataFrame:
    """Assistant and user entries as rows of a turn's columns; said: a user entry's text."""
    use = F.col("a.message.usage")
    blocks = F.col("a.message.content")
    tools = F.filter(blocks, lambda b: b["type"] == "tool_use")
    known = lambda t: F.when(t.isin("text", "tool_use", "tool_result", "thinking"), t).otherwise("other")
    rows = entries.where("entry_type in ('assistant', 'user') and status = 'ok'").select(
        "entry_type", "path", "session_id", "project", "run_id", "is_agent",
        F.when(F.col("is_agent"), F.col("path")).otherwise("").alias("file_id"),
        "line_pos",
        F.col("a.uuid").alias("uuid"),
        F.col("a.requestId").alias("request_id"),
        F.when(F.rlike("a.timestamp", F.lit(RFC3339)), F.try_to_timestamp("a.timestamp")).alias("ts"),
        F.col("a.message.model").alias("model"),
        *(F.coalesce(use[n], F.lit(0)).alias(m) for n, m in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_input_tokens", "cache_creation"), ("cache_read_input_tokens", "cache_read"))),
        use["cache_creation"].isNotNull().alias("has_ttl"),
        F.coalesce(use["cache_creation"]["ephemeral_5m_input_tokens"], F.lit(0)).alias("cw_5m"),
        F.coalesce(use["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0)).alias("cw_1h"),
        F.col("a.message.stop_reason").alias("stop_reason"),
        one_of(F.col("a.message.stop_reason"), *STOP_REASONS).alias("normalized_stop_reason"),
        F.col("a.isSidechain").alias("is_sidechain"),
        F.col("a.agentId").alias("entry_agent_id"),
        F.coalesce(F.transform(tools, lambda b: b["name"]), F.array().cast("array<string>")).alias("tool_names"),
        F.coalesce(F.transform(blocks, lambda b: known(b["type"])), F.array().cast("array<string>")).alias("content_types"),
        F.coalesce(F.size(F.filter(blocks, lambda b: (b["type"] == "tool_result") & b["is_error"])), F.lit(0)).alias("tool_errors"),
        assistant_text().alias("assistant_text"),
        one_of(use["service_tier"], *TIERS).alias("service_tier"), one_of(use["speed"], *SPEEDS).alias("speed"), use["inference_geo"].alias("inference_geo"),
        F.col("a.gitBranch").alias("git_branch"), F.col("a.attributionPlugin").alias("plugin"), F.col("a.attributionSkill").alias("skill"),
        F.when(F.col("entry_type") == "user", truncate_bytes(user_text(), 503)).alias("said"),
    )
    return rows.withColumn("skip_reason", skip_reason(now))


def turns(records: DataFrame) -> DataFrame:
    """Validated records, the last of each request in its file, without agents' repeats of their session's main file."""
    return without_repeats_of_main(last_of_request(records.where("skip_reason is null").drop("skip_reason", "is_sidechain")))


def quality(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Counters of each file: lines, parse errors (blank lines and drift among them), skipped records, repeats, turns."""
    read = entries.groupBy("path").agg(F.count("*").alias("total_lines"), F.count_if(F.col("status").isin("blank", "json", "drift")).alias("parse_errors"))
    valid, rid = F.col("skip_reason").isNull(), F.nullif(F.col("request_id"), F.lit(""))
    per = records.groupBy("path").agg(
        *(F.count_if(F.col("skip_reason") == r).alias(f"skipped_{r}") for r in ("sidechain", "synthetic", "invalid")),
        F.count_if(valid).alias("valid"),
        (F.count(F.when(valid, rid)) - F.count_distinct(F.when(valid, rid))).alias("duplicate_turns"),
    )
    out = read.join(per, "path", "left").fillna(0)
    return out.select("path", "total_lines", "parse_errors", "skipped_sidechain", "skipped_synthetic", "skipped_invalid", "duplicate_turns", (F.col("valid") - F.col("duplicate_turns")).alias("valid_turns"))


def agent_meta(spark: SparkSession, home: str) -> DataFrame:
    """(session_id, stem, agent_type, description) of the sidecars; one beside the agents wins over a workflow's. Malformed ones are left out."""
    text = _tree(spark, home, "text", "*.meta.json", wholetext="true")
    if text is None:
        return spark.createDataFrame([], "session_id string, stem string, agent_type string, description string")
    path = F.regexp_replace(source_path(), r"\.meta\.json$", ".jsonl")
    m = _laid_out(text.select(path.alias("path"), F.from_json("value", META, PERMISSIVE).alias("m"))).where("is_agent and dir is not null and m is not null and m._corrupt is null")
    first = m.groupBy(F.col("dir").alias("session_id"), "stem").agg(F.min_by("m", F.struct(F.col("run_id").isNotNull(), "path")).alias("m"))
    return first.select("session_id", "stem", F.col("m.agentType").alias("agent_type"), F.col("m.description").alias("description"))


def subagents(files: DataFrame, turns: DataFrame, meta: DataFrame) -> DataFrame:
    """One row an agent file, those without turns too; without a type: 'unknown'."""
    per = priced(turns.where("is_agent")).groupBy("path").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation") + F.col("cache_read")).alias("tokens"), F.sum("cost").alias("cost"))
    own = files.where("is_agent").join(per, "path", "left").fillna(0, ["turns", "output_tokens", "tokens", "cost"]).join(meta, ["session_id", "stem"], "left")
    return own.select("session_id", F.substring("stem", len("agent-") + 1, 1 << 20).alias("agent_id"), "run_id", F.coalesce(F.nullif(F.col("agent_type"), F.lit("")), F.lit("unknown")).alias("agent_type"), F.coalesce("description", F.lit("")).alias("description"), "turns", "output_tokens", "tokens", "cost")


def subagent_types(subagents: DataFrame) -> DataFrame:
    per = subagents.groupBy("session_id", "agent_type").agg(F.count("*").alias("agents"), *(F.sum(c).alias(c) for c in ("turns", "output_tokens", "cost")), F.sort_array(F.collect_list(F.struct("agent_id", "description"))).alias("d"))
    return per.withColumn("descriptions", F.col("d.description")).drop("d")


def agent_summary(turns: DataFrame, meta: DataFrame) -> DataFrame:
    """Agent turns by the agentId that the entries themselves name, with the type and description of its sidecar."""
    per = priced(turns.where("is_agent and entry_agent_id <> ''")).groupBy("session_id", "entry_agent_id").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
    named = meta.select("session_id", F.substring("stem", len("agent-") + 1, 1 << 20).alias("entry_agent_id"), "agent_type", "description")
    return per.join(named, ["session_id", "entry_agent_id"], "left").withColumns({"agent_type": F.coalesce("agent_type", F.lit("unknown")), "description": F.coalesce("description", F.lit(""))})


def sessions(files: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a session, without turns too; a session of agents alone is an orphan, of its first agent's project."""
    own = files.groupBy("session_id").agg(F.coalesce(F.min(F.when(~F.col("is_agent"), F.col("project"))), F.min_by("project", "stem"), F.lit("(orphan)")).alias("project"), F.every("is_agent").alias("is_orphan"), F.count_if("is_agent").alias("agent_files"))
    per = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if("is_agent").alias("agent_turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return own.join(per, "session_id", "left").fillna(0, ["turns", "agent_turns"])


def hooks(entries: DataFrame) -> DataFrame:
    """(session_id, command, ...) from the hook summaries of main files; infos without a command are left out."""
    s = entries.where("entry_type = 'system' and status = 'ok' and not is_agent").where(_field("subtype") == "stop_hook_summary")
    failed = F.coalesce(F.size(_field("hookErrors", "array<variant>")), F.lit(0)) > 0
    e = s.select("session_id", failed.alias("failed"), F.coalesce(_field("preventedContinuation", "boolean"), F.lit(False)).alias("prevented"), F.explode(_field("hookInfos", "array<struct<command:string,durationMs:bigint>>")).alias("h"))
    return e.where("h.command <> ''").groupBy("session_id", F.col("h.command").alias("command")).agg(F.count("*").alias("invocations"), F.coalesce(F.sum("h.durationMs"), F.lit(0)).alias("total_duration_ms"), F.count_if("failed").alias("errors"), F.count_if("prevented").alias("prevented"))


def metadata(entries: DataFrame) -> DataFrame:
    """What the entries of a session's main file say besides turns: title, mode, tags, links, counts. The last value wins; lists keep their order."""

    def of(kind: str, value: Column) -> Column:
        return F.when((F.col("entry_type") == kind) & (F.col("status") == "ok"), value)

    def last(kind: str, name: str) -> Column:
        value = of(kind, _field(name))
        return F.max_by(value, F.when(value.isNotNull(), F.col("line_pos")))

    def count(kind: str, also: Column | None = None) -> Column:
        return F.count(of(kind, F.lit(1) if also is None else F.when(also, 1)))

    tag = of("tag", _field("tag"))
    link = of("pr-link", F.struct(_field("prNumber", "bigint").alias("number"), _field("prRepository").alias("repository"), _field("prUrl").alias("url")))
    complete = link["number"].isNotNull() & link["repository"].isNotNull() & link["url"].isNotNull()
    collapse = of("marble-origami-commit", F.struct(F.coalesce(_field("collapseId"), F.lit("")).alias("id"), F.coalesce(_field("summary"), F.lit("")).alias("summary")))
    filled = (collapse["id"] != "") | (collapse["summary"] != "")
    spans = F.coalesce(_field("staged", "array<struct<risk:double>>"), F.array().cast("array<struct<risk:double>>"))
    risks = F.filter(F.transform(spans, lambda x: x["risk"]), lambda x: x.isNotNull())
    mean = F.when(F.size(risks) == 0, F.lit(0.0)).otherwise(F.aggregate(risks, F.lit(0.0), lambda a, x: a + x) / F.size(risks))
    staged = of("marble-origami-snapshot", F.struct(F.size(spans).alias("staged"), mean.alias("mean_risk"), F.greatest(F.lit(0.0), F.coalesce(F.array_max(risks), F.lit(0.0))).alias("max_risk"), F.coalesce(_field("armed", "boolean"), F.lit(False)).alias("armed"), F.coalesce(_field("lastSpawnTokens", "bigint"), F.lit(0)).alias("last_spawn_tokens")))
    states = F.coalesce(_field("fileStates", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    given = F.aggregate(F.map_values(states), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_variant_get(x, "$.claudeContribution", "bigint"), F.lit(0)))
    credit = of("attribution-snapshot", F.struct(F.coalesce(_field("surface"), F.lit("")).alias("surface"), F.size(states).alias("files"), given.alias("contribution"), _field("promptCount", "bigint").alias("prompts")))
    out = entries.where("not is_agent").groupBy("session_id").agg(
        F.coalesce(last("custom-title", "customTitle"), last("ai-title", "aiTitle")).alias("title"),
        last("mode", "mode").alias("mode"),
        F.array_sort(F.collect_list(F.when(tag.isNotNull(), F.struct("line_pos", tag.alias("x"))))).alias("tags"),
        F.array_sort(F.collect_list(F.when(complete, F.struct("line_pos", link.alias("x"))))).alias("links"),
        count("user").alias("user_entries"),
        count("assistant", F.col("a.error").isNotNull()).alias("api_errors"),
        count("speculation-accept").alias("speculation_accepts"),
        F.coalesce(F.sum(of("speculation-accept", _field("timeSavedMs", "double"))), F.lit(0.0)).alias("speculation_ms"),
        count("queue-operation", _field("operation") == "enqueue").alias("enqueues"),
        count("queue-operation", _field("operation") == "dequeue").alias("dequeues"),
        F.array_sort(F.collect_list(F.when(filled, F.struct("line_pos", collapse.alias("x"))))).alias("collapses"),
        F.max_by(staged, F.when(staged.isNotNull(), F.col("line_pos"))).alias("collapse_snapshot"),
        F.max_by(credit, F.when(credit.isNotNull(), F.col("line_pos"))).alias("attribution"),
        F.min_by(_field("version"), "line_pos").alias("version"),
    )
    out = out.withColumns({"tags": F.array_distinct(F.col("tags.x")), "links": F.col("links.x"), "collapses": F.col("collapses.x")})
    # The first link of each number and repository stays.
    mark = lambda x: F.struct(x["number"], x["repository"])
    return out.withColumn("links", F.filter("links", lambda x, i: F.array_position(F.transform("links", mark), mark(x)) == i + 1))


def graph_nodes(entries: DataFrame) -> DataFrame:
    """(session, uuid, parent): entries with a uuid, by their own sessionId; a system entry may name its parent as the logical one."""
    parent = F.when(F.col("entry_type") == "system", F.coalesce(_field("parentUuid"), _field("logicalParentUuid"))).otherwise(_field("parentUuid"))
    kinds = F.col("entry_type").isin("user", "assistant", "system", "attachment", "progress") & (F.col("status") == "ok")
    return entries.where(kinds | (F.col("status") == "passthrough")).select(_field("sessionId").alias("session"), _field("uuid").alias("uuid"), parent.alias("parent"), F.coalesce(_field("timestamp"), F.lit("")).alias("ts"), "path").where("session is not null and uuid <> ''").dropDuplicates(["session", "uuid"])


def graph_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, roots, orphans (a parent that the session lacks), branch points (more than one child) and files of each session."""
    children = nodes.where("parent is not null").groupBy("session", F.col("parent").alias("uuid")).agg(F.count("*").alias("children"))
    known = nodes.select("session", "uuid", "parent", "path").join(children, ["session", "uuid"], "left")
    lost = children.join(nodes, ["session", "uuid"], "left_anti").groupBy("session").agg(F.sum("children").alias("orphans"))
    per = known.groupBy("session").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("children") > 1).alias("branch_points"), F.count_distinct("path").alias("files"))
    return per.join(lost, "session", "left").fillna(0, ["orphans"])


def top_chains(nodes: DataFrame, rows: int = 10) -> DataFrame:
    """The longest chains, each with its session and first node."""
    return chain_lengths(nodes).orderBy(F.desc("length"), "session", "uuid").limit(rows)


def leaks(entries: DataFrame) -> DataFrame:
    """Metadata entries that stand in the graph all the same: with a uuid, and a parent (summaries without one too)."""
    graph = ("user", "assistant", "system", "attachment", "progress")
    e = entries.where((_field("uuid") != "") & ~F.col("entry_type").isin(*graph) & F.col("entry_type").isin(*ENTRY_TYPES)).where((_field("parentUuid") != "") | (F.col("entry_type") == "summary"))
    side = F.coalesce(_field("isSidechain", "boolean"), F.lit(False))
    return e.groupBy("entry_type").agg(F.count("*").alias("entries"), F.count_if(side).alias("sidechain"), F.min(_field("uuid")).alias("example"))


def unknown_types(entries: DataFrame) -> DataFrame:
    """Types that the format does not declare, of entries with a uuid."""
    return entries.where((_field("uuid") != "") & ~F.coalesce(F.col("entry_type").isin(*ENTRY_TYPES), F.lit(False))).groupBy(F.coalesce("entry_type", F.lit("")).alias("entry_type")).agg(F.count("*").alias("entries"))


def tool_pairs(entries: DataFrame) -> DataFrame:
    """(session_id, tool_use_id, name, answered, is_error): every tool call with its result, by the call's id within the session."""
    blocks = F.explode(_field("message.content", "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean>>"))
    e = entries.where("status = 'ok'")
    calls = e.where("entry_type = 'assistant'").select("session_id", blocks.alias("b")).where("b.type = 'tool_use' and b.id is not null").select("session_id", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("name")).distinct()
    results = e.where("entry_type = 'user'").select("session_id", blocks.alias("b")).where("b.type = 'tool_result'").groupBy("session_id", F.col("b.tool_use_id").alias("tool_use_id")).agg(F.max(F.coalesce("b.is_error", F.lit(False))).alias("is_error"))
    return calls.join(results, ["session_id", "tool_use_id"], "left").withColumn("answered", F.col("is_error").isNotNull())


def reader_counts(entries: DataFrame) -> DataFrame:
    """What a lenient reader counts in each file: malformed lines, drift, and entries of unknown type. Blank lines are passed over."""
    return entries.groupBy("path").agg(F.count_if(F.col("status") == "json").alias("errors_skipped"), F.count_if(F.col("status") == "drift").alias("struct_drift"), F.count_if(F.col("status").isin("passthrough", "ignored")).alias("unknown"))


def strict(entries: DataFrame) -> DataFrame:
    """The entries without blank lines; reading a malformed or drifted one fails."""
    bad = F.raise_error(F.concat(F.lit("a line that cannot be read ("), F.col("status"), F.lit(") in "), F.col("path")))
    return entries.where("status <> 'blank'").withColumn("status", F.when(F.col("status").isin("json", "drift"), bad.cast("string")).otherwise(F.col("status")))


def load_session(entries: DataFrame, session_id: str) -> DataFrame:
    """One session's entries, its agents' too; an error where it has no main file, whatever agents name it."""
    own = entries.where(F.col("session_id") == session_id)
    if not own.where("not is_agent").limit(1).count():
        raise LookupError(f"no main file of session {session_id}")
    return own


def session_quality(files: DataFrame, quality: DataFrame, records: DataFrame, turns: DataFrame) -> DataFrame:
    """Counters of a session: its files' together; agents' requests that the main file has too count as repeats."""
    names = ["total_lines", "parse_errors", "skipped_sidechain", "skipped_synthetic", "skipped_invalid", "duplicate_turns", "valid_turns"]
    kept = turns.groupBy("session_id").agg(F.count("*").alias("kept"))
    per = files.join(quality, "path", "left").fillna(0, names).groupBy("session_id").agg(*(F.sum(n).alias(n) for n in names)).join(kept, "session_id", "left").fillna(0, ["kept"])
    return per.withColumn("duplicate_turns", F.col("duplicate_turns") + F.col("valid_turns") - F.col("kept")).withColumn("valid_turns", F.col("kept")).drop("kept")


def global_quality(files: DataFrame, quality: DataFrame, turns: DataFrame) -> DataFrame:
    """One row: files, agents, parents of orphans, turns before the cross-file dedup, skipped records, first and last turn."""
    f = files.groupBy("session_id").agg(F.count_if(~F.col("is_agent")).alias("main"), F.count_if("is_agent").alias("agents"))
    f = f.agg(F.coalesce(F.sum("main"), F.lit(0)).alias("session_files"), F.coalesce(F.sum("agents"), F.lit(0)).alias("agent_files"), F.count_if(F.col("main") == 0).alias("orphan_agents"))
    q = files.join(quality, "path", "left").agg(F.coalesce(F.sum("valid_turns"), F.lit(0)).alias("valid_turns"), F.coalesce(F.sum(F.col("parse_errors") + F.col("skipped_sidechain") + F.col("skipped_synthetic") + F.col("skipped_invalid")), F.lit(0)).alias("skipped"))
    return f.crossJoin(q).crossJoin(turns.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))  # one row each


# What a path that is no transcript holds, and its name; the first that fits counts.
OTHER_FILES = (
    ("projects-title-backup-", "backup-dir"), ("/subagents/workflows/.*/journal\\.jsonl$", "workflow-journal"), ("/history\\.jsonl$", "history"), ("/metrics/", "metrics"), ("/todos/", "todos"), ("/statsig/", "statsig"),
    ("/ide/", "ide-state"), ("/shell-snapshots/", "shell-snapshots"), ("/state/", "state"), ("/preferences", "preferences"), ("/homunculus/", "homunculus-observations"),
)


def audit(spark: SparkSession, home: str) -> DataFrame:
    """(bucket, path) of every JSON lines file below home that is no transcript; bucket OTHER: nothing that is known."""
    everything = _paths(spark, home, "*.jsonl")
    bucket = F.lit("OTHER")
    for pattern, name in reversed(OTHER_FILES):
        bucket = F.when(F.rlike("path", F.lit(pattern)), name).otherwise(bucket)
    return everything.join(files(spark, home).select("path"), "path", "left_anti").select(bucket.alias("bucket"), "path")


def survey(entries: DataFrame, name: str, entry_type: str = "user", samples: int = 2) -> DataFrame:
    """(shape, entries, percent, samples) of a field over the entries of a type: which shapes its values have."""
    value = _field(name, "variant")
    e = entries.where(F.col("entry_type") == entry_type).where(value.isNotNull()).select(shape(value).alias("shape"), F.substring(F.to_json(value), 1, 300).alias("sample"))
    per = e.groupBy("shape").agg(F.count("*").alias("entries"), F.slice(F.array_sort(F.array_distinct(F.array(F.min("sample"), F.max("sample")))), 1, samples).alias("samples"))
    total = per.agg(F.sum("entries").alias("all"))
    return per.crossJoin(total).select("shape", "entries", (F.col("entries") * 1e2 / F.col("all")).alias("percent"), "samples")  # total is one row


def survey_all(entries: DataFrame, samples: int = 2) -> DataFrame:
    """(entry_type, path, shape, entries, percent, samples): survey() of every field at once, and of the fields of objects in fields.

    Each entry's object is opened to a depth of two within its row (a path is `name` or `name.inner`), so the lines
    are read once, and all fields are grouped together, with map-side combine and bounded samples. percent: of the
    entries of the type that have the field.
    """
    pair = "array<struct<path:string,value:variant>>"
    opened = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")).cast(pair)
    inner = lambda x: F.transform(F.coalesce(opened(x["value"]), F.array().cast(pair)), lambda y: F.struct(F.concat(x["path"], F.lit("."), y["path"]).alias("path"), y["value"].alias("value")))
    top = entries.select("entry_type", opened(F.col("v")).alias("top")).where("top is not null")
    fields = top.select("entry_type", F.explode(F.concat("top", F.flatten(F.transform("top", inner)))).alias("f")).select("entry_type", "f.path", "f.value").where("value is not null")
    e = fields.select("entry_type", "path", shape(F.col("value")).alias("shape"), F.substring(F.to_json("value"), 1, 300).alias("sample"))
    per = e.groupBy("entry_type", "path", "shape").agg(F.count("*").alias("entries"), F.slice(F.array_sort(F.array_distinct(F.array(F.min("sample"), F.max("sample")))), 1, samples).alias("samples"))
    share = F.col("entries") * 1e2 / F.sum("entries").over(Window.partitionBy("entry_type", "path"))  # a row for each shape
    return per.select("entry_type", "path", "shape", "entries", share.alias("percent"), "samples")


def journals(spark: SparkSession, home: str) -> DataFrame:
    """(session_id, run_id, entries): what each run's journal says, in order; blank and malformed lines are left out, an empty journal has none."""
    place = r"/projects/[^/]+/([^/]+)/subagents/workflows/(wf_[^/]+)/journal\.jsonl$"
    at = lambda df: df.withColumns({n: F.regexp_extract("path", place, k + 1) for k, n in enumerate(("session_id", "run_id"))}).where("run_id <> ''")
    text = lines(spark, home, "journal.jsonl")
    v = at(text).withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    per = v.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_pos", _field("type").alias("type"), _field("key").alias("key"), _field("agentId").alias("agent_id"), F.to_json(_field("result", "variant")).alias("result")))).alias("x"))
    per = per.select("path", F.transform("x", lambda x: F.struct(x["type"].alias("type"), x["key"].alias("key"), x["agent_id"].alias("agent_id"), x["result"].alias("result"))).alias("entries"))
    return at(_paths(spark, f"{home}/projects", "journal.jsonl")).join(per, "path", "left").select("session_id", "run_id", F.coalesce("entries", F.array().cast(per.schema["entries"].dataType)).alias("entries"))


def scripts(spark: SparkSession, home: str) -> DataFrame:
    """(session_id, run_id, scripts): paths of the scripts whose names end with the run's id."""
    place = r"/projects/[^/]+/([^/]+)/workflows/scripts/[^/]*(wf_[^/]+)\.js$"
    s = _paths(spark, f"{home}/projects", "*.js").select("path", F.regexp_extract("path", place, 1).alias("session_id"), F.regexp_extract("path", place, 2).alias("run_id")).where("run_id <> ''")
    return s.groupBy("session_id", "run_id").agg(F.sort_array(F.collect_list("path")).alias("scripts"))


def workflow_runs(spark: SparkSession, home: str, subagents: DataFrame) -> DataFrame:
    """One row a run that has a snapshot file or agents: what the snapshot says (null where it cannot be read), and the measured agents, turns, tokens, cost.

    journal_entries is null without a journal, 0 for an empty one.
    """
    per = subagents.where("run_id is not null").groupBy("session_id", "run_id").agg(F.count("*").alias("agents"), *(F.sum(c).alias(c) for c in ("turns", "output_tokens", "tokens", "cost")))
    said = {"workflow": ("workflowName", "string"), "status": ("status", "string"), "duration_ms": ("durationMs", "bigint"), "snapshot_agents": ("agentCount", "bigint"), "snapshot_tokens": ("totalTokens", "bigint"), "phases": ("phases", "array<struct<title:string,detail:string>>")}
    text = _tree(spark, home, "text", "wf_*.json", wholetext="true")
    if text is None:
        snap = spark.createDataFrame([], "session_id string, run_id string").select("*", *(F.lit(None).cast(t).alias(n) for n, (_, t) in said.items()))
    else:
        place = r"/projects/[^/]+/([^/]+)/workflows/(wf_[^/]+)\.json$"
        snap = text.select(F.regexp_extract(source_path(), place, 1).alias("session_id"), F.regexp_extract(source_path(), place, 2).alias("run_id"), F.try_parse_json("value").alias("v")).where(F.rlike("session_id", F.lit(UUID)))
        snap = snap.select("session_id", "run_id", *(_field(p, t).alias(n) for n, (p, t) in said.items()))
    out = snap.join(per, ["session_id", "run_id"], "full").fillna(0, ["agents", "turns", "output_tokens", "tokens", "cost"])
    journal = journals(spark, home).select("session_id", "run_id", F.size("entries").alias("journal_entries"))
    return out.join(scripts(spark, home), ["session_id", "run_id"], "left").join(journal, ["session_id", "run_id"], "left")


def load_sidecars(spark: SparkSession, home: str, session_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """One session's agent sidecars and workflow runs (those with a snapshot or agents), with what its agents did."""
    own, named = F.col("session_id") == session_id, loose_names(spark, home)
    meta = agent_meta(spark, home).where(own)
    did = turns(records(entries(spark, home, named).where(own), now))
    return meta, workflow_runs(spark, home, subagents(files(spark, home, named).where(own), did, meta)).where(own)


def load_all(spark: SparkSession, home: str, now: str) -> dict[str, DataFrame]:
    """The tables of a tree, by name: files, entries, records, turns, sessions (with what their entries say), quality, session_quality and global_quality."""
    named = loose_names(spark, home)
    f, e = files(spark, home, named), entries(spark, home, named)
    r = records(e, now)
    t = turns(r)
    q = quality(e, r)
    return {"files": f, "entries": e, "records": r, "turns": t, "sessions": sessions(f, t).join(metadata(e), "session_id", "left"), "quality": q, "session_quality": session_quality(f, q, r, t), "global_quality": global_quality(f, q, t)}
