"""A small transcript tree with known answers."""

import json

import pytest

from tallyloom.plans.registry import tree_report
from tallyloom.sources import transcripts as T

MAIN, LOST = "11111111-2222-3333-4444-555555555555", "99999999-2222-3333-4444-555555555555"
NOW = "2026-06-01 00:00:00"


def turn(rid, out, at="2026-03-16T10:00:00Z", session=MAIN, tools=(), **more):
    usage = {"input_tokens": 10, "output_tokens": out, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 0}
    message = {"model": "claude-opus-4-6", "role": "assistant", "stop_reason": "end_turn", "usage": usage, "content": [{"type": "tool_use", "name": t} for t in tools]}
    return {"type": "assistant", "uuid": f"u-{rid}-{out}", "parentUuid": "p1", "sessionId": session, "timestamp": at, "requestId": rid, "message": message} | more


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    project = root / "projects" / "-Users-dev-alpha"

    def put(name, *rows):
        p = project / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))

    bad = turn("bad", 1)
    bad["message"]["usage"]["input_tokens"] = "x"
    fake = turn("fake", 1)
    fake["message"]["model"] = "<synthetic>"
    none = turn("none", 0)
    none["message"]["usage"]["input_tokens"] = 0
    orphan = turn("no-parent", 1)
    del orphan["parentUuid"]
    put(
        f"{MAIN}.jsonl",
        {"type": "user", "uuid": "p1", "sessionId": MAIN, "parentUuid": None, "message": {"role": "user", "content": "hello"}},
        turn("r1", 20, tools=("Bash", "Edit")),
        turn("r1", 25, tools=("Bash", "Edit")),
        {"type": "user", "uuid": "p2", "sessionId": MAIN, "parentUuid": "gone", "message": {"role": "user", "content": [{"type": "tool_result", "content": "x"}]}},
        turn("r2", 40, attributionPlugin="superpowers", tools=("Bash",)),
        turn(None, 5), turn("", 5), turn("side", 1, isSidechain=True), turn("late", 1, at="2026-07-01T00:00:00Z"), turn("date", 1, at="nope"),
        bad, fake, none, orphan, "not json", "", {"type": "new-kind", "uuid": "k", "sessionId": MAIN}, {"type": "new-kind"},
        {"type": "system", "subtype": "stop_hook_summary", "uuid": "h", "sessionId": MAIN, "parentUuid": "p1", "hookInfos": [{"command": "fmt", "durationMs": 50}, {"command": ""}], "hookErrors": ["e"], "preventedContinuation": False},
        {"type": "ai-title", "aiTitle": "first"}, {"type": "custom-title", "customTitle": "mine"}, {"type": "ai-title", "aiTitle": "second"},
        {"type": "tag", "tag": "b"}, {"type": "tag", "tag": "a"}, {"type": "tag", "tag": "b"}, {"type": "queue-operation", "operation": "enqueue"},
        {"type": "pr-link", "prNumber": 7, "prUrl": "u", "prRepository": "r"}, {"type": "speculation-accept", "timeSavedMs": 1.5},
        {"type": "pr-link", "prNumber": 8, "prUrl": "v", "prRepository": "r"}, {"type": "pr-link", "prNumber": 7, "prUrl": "again", "prRepository": "r"},
        {"type": "marble-origami-commit", "collapseId": "c", "summary": "s"}, {"type": "marble-origami-commit"},
        {"type": "marble-origami-snapshot", "staged": [{"risk": 0.9}]}, {"type": "marble-origami-snapshot", "staged": [{"risk": 0.2}, {}, {"risk": 0.4}], "armed": True},
        {"type": "attribution-snapshot", "surface": "cli", "fileStates": {"a": {"claudeContribution": 5}, "b": {"claudeContribution": 7}, "c": {}}, "promptCount": 3},
    )
    put(f"{MAIN}/subagents/agent-a.jsonl", turn("r2", 40, isSidechain=True), turn("r3", 7, isSidechain=True))
    (project / MAIN / "subagents" / "agent-a.meta.json").write_text(json.dumps({"agentType": "builder", "description": "d"}))
    put(f"{MAIN}/subagents/workflows/wf_1/agent-w.jsonl", turn("r4", 8))
    (project / MAIN / "subagents" / "workflows" / "wf_1" / "agent-w.meta.json").write_text("not json")
    (project / MAIN / "workflows").mkdir()
    (project / MAIN / "workflows" / "wf_1.json").write_text(json.dumps({"workflowName": "build", "status": "done", "agentCount": 2, "totalTokens": 99, "phases": [{"title": "p", "detail": "d"}]}))
    (project / MAIN / "workflows" / "wf_2.json").write_text("not json")
    (project / MAIN / "workflows" / "scripts").mkdir()
    (project / MAIN / "workflows" / "scripts" / "build-wf_1.js").write_text("x")
    put(f"{MAIN}/subagents/workflows/wf_1/journal.jsonl", {"type": "started", "key": "k", "agentId": "w"}, "", "not json", {"type": "result", "key": "k", "agentId": "w", "result": {"x": 1}})
    put(f"{MAIN}/subagents/workflows/wf_9/journal.jsonl")
    put("todos/list.jsonl", {"a": 1})
    put(f"{MAIN}/subagents/agent-empty.jsonl")
    put("agent-old.jsonl", turn("r5", 9, session=MAIN))
    put(f"{LOST}/subagents/agent-z.jsonl", turn("r6", 3, session=LOST))
    put("memory/notes.jsonl", turn("m", 1))
    put("other.jsonl", turn("o", 1))
    return str(root)


@pytest.fixture(scope="module")
def read(spark, home):
    e = T.entries(spark, home).cache()
    r = T.records(e, NOW).cache()
    return T.files(spark, home), e, r, T.turns(r).cache()


def test_files(read):
    got = {(r.stem, r.session_id, r.run_id, r.is_agent) for r in read[0].collect()}
    assert got == {(MAIN, MAIN, None, False), ("agent-a", MAIN, None, True), ("agent-w", MAIN, "wf_1", True), ("agent-old", MAIN, None, True), ("agent-z", LOST, None, True), ("agent-empty", MAIN, None, True)}


def test_turns(read):
    got = sorted((r.request_id or "", r.output_tokens, r.is_agent, r.user_text or "") for r in read[3].collect())
    assert got == [("", 5, False, "hello"), ("", 5, False, "hello"), ("r1", 25, False, "hello"), ("r2", 40, False, "hello"), ("r3", 7, True, ""), ("r4", 8, True, ""), ("r5", 9, True, ""), ("r6", 3, True, "")]


def test_quality(read):
    q = next(r for r in T.quality(read[1], read[2]).collect() if r.path.endswith(f"{MAIN}.jsonl"))
    assert (q.parse_errors, q.skipped_sidechain, q.skipped_synthetic, q.skipped_invalid, q.duplicate_turns, q.valid_turns) == (4, 1, 1, 3, 1, 4)


def test_status(read):
    got = {r.status: r["count"] for r in read[1].where("not is_agent").groupBy("status").count().collect()}
    assert {k: got[k] for k in ("blank", "json", "drift", "passthrough", "ignored")} == {"blank": 1, "json": 1, "drift": 2, "passthrough": 1, "ignored": 1}


def test_agents_and_runs(spark, home, read):
    agents = T.subagents(read[0], read[3], T.agent_meta(spark, home)).cache()
    assert {(r.agent_id, r.agent_type, r.turns) for r in agents.collect()} == {("a", "builder", 1), ("w", "unknown", 1), ("old", "unknown", 1), ("z", "unknown", 1), ("empty", "unknown", 0)}
    runs = {r.run_id: (r.workflow, r.status, r.agents, r.output_tokens) for r in T.workflow_runs(spark, home, agents).collect()}
    assert runs == {"wf_1": ("build", "done", 1, 8), "wf_2": (None, None, 0, 0)}
    types = {(r.session_id, r.agent_type): r.agents for r in T.subagent_types(agents).collect()}
    assert types == {(MAIN, "builder"): 1, (MAIN, "unknown"): 3, (LOST, "unknown"): 1}


def test_sessions(read):
    got = {r.session_id: (r.project, r.is_orphan, r.turns, r.agent_turns) for r in T.sessions(read[0], read[3]).collect()}
    assert got == {MAIN: ("-Users-dev-alpha", False, 7, 3), LOST: ("-Users-dev-alpha", True, 1, 1)}


def test_hooks_metadata_graph(read):
    h = T.hooks(read[1]).collect()
    assert [(r.command, r.invocations, r.total_duration_ms, r.errors, r.prevented) for r in h] == [("fmt", 1, 50, 1, 0)]
    m = T.metadata(read[1]).first()
    assert (m.title, m.tags, m.enqueues, m.dequeues, m.user_entries, m.speculation_ms) == ("mine", ["b", "a"], 1, 0, 2, 1.5)
    assert [(x.number, x.repository, x.url) for x in m.links] == [(7, "r", "u"), (8, "r", "v")]
    assert [(c.id, c.summary) for c in m.collapses] == [("c", "s")]
    assert (m.collapse_snapshot.staged, round(m.collapse_snapshot.mean_risk, 6), m.collapse_snapshot.max_risk, m.collapse_snapshot.armed) == (3, 0.3, 0.4, True)
    assert (m.attribution.surface, m.attribution.files, m.attribution.contribution, m.attribution.prompts) == ("cli", 3, 12, 3)
    g = {r.session: r for r in T.graph_stats(T.graph_nodes(read[1])).collect()}[MAIN]
    assert (g.orphans, g.branch_points) == (1, 1) and g.roots >= 1


def test_reports_over_a_tree(read):
    assert {r.tool: r.uses for r in tree_report("a08_tools", read[3]).collect()} == {"Bash": 2, "Edit": 1}
    total = tree_report("a04_overview_totals", read[3]).first()
    assert (total.sessions, total.turns, total.agent_turns) == (2, 8, 4)


def test_no_tree(spark, tmp_path):
    assert T.entries(spark, str(tmp_path)).count() == 0


def test_runs_journals_and_scripts(spark, home, read):
    agents = T.subagents(read[0], read[3], T.agent_meta(spark, home))
    runs = {r.run_id: r for r in T.workflow_runs(spark, home, agents).collect()}
    assert set(runs) == {"wf_1", "wf_2"}  # a run folder with a journal alone is no run
    one = runs["wf_1"]
    assert (one.snapshot_agents, one.snapshot_tokens, one.journal_entries, [p.title for p in one.phases], len(one.scripts)) == (2, 99, 2, ["p"], 1)
    assert one.cost == 10 * 5000 + 8 * 25000 and runs["wf_2"].journal_entries is None
    j = {r.run_id: [(e.type, e.agent_id, e.result) for e in r.entries] for r in T.journals(spark, home).collect()}
    assert j == {"wf_1": [("started", "w", None), ("result", "w", '{"x":1}')], "wf_9": []}


def test_readers(spark, home, read):
    from pyspark.errors import PySparkException

    c = next(r for r in T.reader_counts(read[1]).collect() if r.path.endswith(f"{MAIN}.jsonl"))
    assert (c.errors_skipped, c.struct_drift, c.unknown) == (1, 2, 2)
    with pytest.raises(PySparkException, match="cannot be read"):
        T.strict(read[1]).collect()
    assert T.strict(read[1].where("status not in ('json', 'drift')")).where("status = 'blank'").count() == 0
    assert T.load_session(read[1], MAIN).where("is_agent").count() > 0
    with pytest.raises(LookupError):
        T.load_session(read[1], LOST)
    assert {(r.bucket, r.path.rsplit("/", 1)[1]) for r in T.audit(spark, home).collect()} == {("workflow-journal", "journal.jsonl"), ("todos", "list.jsonl"), ("OTHER", "notes.jsonl"), ("OTHER", "other.jsonl")}


def test_quality_of_sessions(read):
    q = T.quality(read[1], read[2])
    s = {r.session_id: r for r in T.session_quality(read[0], q, read[2], read[3]).collect()}
    assert (s[MAIN].valid_turns, s[MAIN].duplicate_turns, s[LOST].valid_turns) == (7, 2, 1)
    g = T.global_quality(read[0], q, read[3]).first()
    assert (g.session_files, g.agent_files, g.orphan_agents, g.valid_turns, g.skipped) == (1, 5, 1, 9, 9)


def test_agent_summary(spark, home):
    t = spark.createDataFrame([(MAIN, "a", "claude-opus-4-6", 10), (MAIN, "b", "claude-opus-4-6", 5), (MAIN, "", "claude-opus-4-6", 5)], "session_id string, entry_agent_id string, model string, output_tokens long").selectExpr("*", "true as is_agent", "0L as input_tokens", "0L as cache_creation", "0L as cache_read", "false as has_ttl", "0L as cw_5m", "0L as cw_1h")
    got = {(r.entry_agent_id, r.agent_type, r.description, r.cost) for r in T.agent_summary(t, T.agent_meta(spark, home)).collect()}
    assert got == {("a", "builder", "d", 250_000), ("b", "unknown", "", 125_000)}


def test_validator(spark, home, read):
    from pyspark.sql import functions as F

    from tallyloom.plans import validate

    c = validate.checks(spark, home, NOW).cache()
    failed = {r.name: (r.expected, r.actual) for r in validate.failures(c).collect()}
    # The recount takes the two drifted lines, which the typed reader leaves out; wf_2 has no agents, wf_1 one of two.
    assert failed == {"main_turn_count": ("6", "4"), "main_input_tokens": ("50", "40"), "main_output_tokens": ("77", "75"), "workflow[wf_1] agent_count == snapshot": ("2", "1"), "workflow[wf_2] parsed tokens > 0 (no loss)": ("true", "false")}
    s = validate.summary(c).first()
    assert (s.failed, s.sessions_validated, s.sessions_passed, s.total_checks - s.passed) == (5, 2, 1, 5)
    # A planted error in the pipeline's turns fails the checks that see it, and no other session's.
    wrong = read[3].withColumn("output_tokens", F.when(F.col("session_id") == LOST, 1000).otherwise(F.col("output_tokens")).cast("long"))
    failed = {(r.session_id, r.name) for r in validate.failures(validate.checks(spark, home, NOW, prefix=LOST[:4], pipeline_turns=wrong)).collect()}
    assert failed == {(LOST, "agent_output_tokens (±5%)")}


def test_graph_checks_leaks_and_pairs(spark, read):
    from tallyloom.plans import validate

    failed = {r.name: r.actual for r in validate.failures(validate.graph_checks(read[1])).collect()}
    assert failed == {"drift": "2", "errors": "1", "unknown": "1", "orphans": "2"}
    v = spark.createDataFrame([("summary", '{"uuid":"1"}'), ("tag", '{"uuid":"2","parentUuid":"p"}'), ("mode", '{"uuid":"3"}'), ("user", '{"uuid":"4","parentUuid":"p"}')], "entry_type string, value string").selectExpr("*", "try_parse_json(value) as v")
    assert {(r.entry_type, r.entries, r.sidechain) for r in T.leaks(v).collect()} == {("summary", 1, 0), ("tag", 1, 0)}
    call, answer = '{"message":{"content":[{"type":"tool_use","id":"t1","name":"Bash"},{"type":"tool_use","id":"t2","name":"Edit"}]}}', '{"message":{"content":[{"type":"tool_result","tool_use_id":"t1","is_error":true}]}}'
    e = spark.createDataFrame([("assistant", call), ("user", answer)], "entry_type string, value string").selectExpr("*", "try_parse_json(value) as v", "'ok' as status", "'s' as session_id")
    assert {(r.tool_use_id, r.name, r.answered, r.is_error) for r in T.tool_pairs(e).collect()} == {("t1", "Bash", True, True), ("t2", "Edit", False, None)}
    assert [(r.session, r.length) for r in T.top_chains(T.graph_nodes(read[1]), 1).collect()] == [(MAIN, 2)]


def test_shapes(spark):
    from tallyloom.sources import shapes as S

    def over(*rows):
        return spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k long, value string").selectExpr("*", "try_parse_json(value) as v")

    def values(df, c):
        return [r[1] for r in sorted(df.select("k", c.alias("x")).collect())]

    user = lambda content, **k: {"type": "user", "message": {"content": content}} | k
    b = lambda t: {"type": t}
    d = over(user("x"), user([b("tool_result")]), user([b("text")]), user([b("image"), b("text")]), user([b("text"), b("tool_result")]), user([]), {"type": "user", "message": {}}, user([{}]), user("x", toolUseResult="no"))
    assert values(d, S.content_kind()) == ["String", "ToolResult", "Text", "ImageText", "Mixed", "Mixed", None, "Mixed", "String"]
    assert values(d, S.user_kind()) == ["RealInput", "ToolResult", "RealInput", "RealInput", "ToolResult", "RealInput", "RealInput", "RealInput", "ToolResult"]
    r = lambda x: {"type": "user", "toolUseResult": x}
    bash = {"interrupted": False, "isImage": False, "noOutputExpected": False, "stderr": "", "stdout": "x"}
    d = over(r("no"), r(bash), r(bash | {"stdout": 5}), r({"task": {}}), r({"task": {}, "x": 1}), r({"file": {}, "type": "text"}), r([1]), r({"answers": {}, "questions": []}), r({"query": "q", "results": [], "durationSeconds": 1.5}), {"type": "user"}, r({"isAsync": True, "agentId": "a9", "status": "s", "outputFile": "f"}))
    assert values(d, S.tool_result_kind()) == ["Rejected", "Bash", "Other", "TaskCreate", "Other", "Read", "Other", "AskUser", "WebSearch", None, "TaskAsync"]
    assert values(d, S.agent_id())[-1] == "a9"
    d = over({"type": "system", "subtype": "turn_duration", "durationMs": 5, "content": "no"}, {"type": "system", "subtype": "new"}, {"type": "attachment", "attachment": {"type": "hook_success", "exitCode": 0}}, {"type": "attachment", "attachment": {"type": "hook_success", "exitCode": "bad"}}, {"type": "attachment"}, {"type": "progress", "data": {"type": "odd"}}, {"type": "user"})
    assert values(d, S.subtype()) == ["turn_duration", "unknown", "hook_success", "hook_success", None, "unknown", None]
    assert values(d, S.attachment_subtype())[2:5] == ["hook_success", "unknown", None]
    one = d.where("k = 0").select(*S.body_fields("system")).first()
    assert (one.durationMs, one.content, one.hookCount) == (5, None, None)
    d = over({"f": [1, "x", {"b": 1, "a": [2]}]}, {"f": {}}, {"f": []}, {"f": 1.5}, {"f": None}, {"f": {"k": 1, "c": 2}}, {"f": [[1]]})
    assert values(d, S.shape(S.field("f", "variant"))) == ["array[int,obj{a,b},string]", "obj{empty}", "array[empty]", "float", "null", "obj{c,k}", "array[array[int]]"]


def test_load_all_and_sidecars(spark, home):
    t = T.load_all(spark, home, NOW)
    s = {r.session_id: (r.title, r.turns, r.is_orphan) for r in t["sessions"].collect()}
    assert s == {MAIN: ("mine", 7, False), LOST: (None, 1, True)} and t["global_quality"].first().agent_files == 5
    meta, runs = T.load_sidecars(spark, home, MAIN, NOW)
    assert [r.agent_type for r in meta.collect()] == ["builder"] and {(r.run_id, r.agents, r.turns, r.output_tokens, r.cost > 0) for r in runs.collect()} == {("wf_1", 1, 1, 8, True), ("wf_2", 0, 0, 0, False)}


def test_survey_of_all_fields(read):
    """What a call for each field says, from one pass over the lines."""
    got = T.survey_all(read[1]).collect()
    for kind, name in (("user", "message"), ("user", "message.content"), ("user", "parentUuid"), ("assistant", "message.usage"), ("assistant", "requestId"), ("system", "hookInfos"), ("marble-origami-snapshot", "staged"), ("attribution-snapshot", "fileStates")):
        own = sorted(map(str, ((r["shape"], r.entries, round(r.percent, 6), r.samples) for r in got if (r.entry_type, r.path) == (kind, name))))
        assert own == sorted(map(str, ((r["shape"], r.entries, round(r.percent, 6), r.samples) for r in T.survey(read[1], name, kind).collect()))) and own
    assert T.survey_all(read[1])._jdf.queryExecution().analyzed().toString().count("Relation [value") <= read[1]._jdf.queryExecution().analyzed().toString().count("Relation [value")
