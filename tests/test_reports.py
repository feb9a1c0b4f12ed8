"""Reports against the same SQL on DuckDB, and known values of the price table."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.pricing import load_config, priced, resolve
from tallyloom.operators.turns import last_of_request, without_repeats_of_main
from tallyloom.functions.scalars import compact_number, escape_html, escape_script, format_cost, format_duration, truncate_bytes
from tallyloom.operators.graph import chain_lengths
from tallyloom.plans.registry import ORACLE_SQL, QUERIES, tree_report
from tallyloom.plans.reports import streaks, thresholds

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False, name=None):
        out.append(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    con.execute("set timezone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def shared_ids(tmp_path_factory):
    """Events of users whose ids are longer than a session id keeps, so that records of one session name several projects."""
    at = tmp_path_factory.mktemp("shared")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (event_id + 5000 * k as event_id, user_id + 15000 * k as user_id) from read_parquet('{SF}/events.parquet'), range(4) t(k)) to '{at}/events.parquet'")
    con.execute(f"create view events as select * from read_parquet('{at}/events.parquet')")
    con.execute("set timezone = 'UTC'")
    return at, con


@pytest.mark.parametrize("name", ["a15_projects", "f06_projects_by_name", "t01_top_projects", "t08_table_sort"])
def test_sessions_that_name_several_projects(spark, shared_ids, name):
    at, con = shared_ids
    assert rows(QUERIES[name](spark, str(at)).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_agents_of_another_folder_count_for_their_session(spark):
    t = spark.createDataFrame([("s", "b", False, -1, 1), ("s", "a", True, 1, 2)], "session_id string, project string, is_agent boolean, file_id long, line_pos long")
    t = t.selectExpr("*", "timestamp '2025-03-10 10:00:00' as ts", "'claude-opus-4-6' as model", "10L as input_tokens", "5L as output_tokens", "0L as cache_creation", "0L as cache_read", "false as has_ttl", "0L as cw_5m", "0L as cw_1h")
    own = spark.createDataFrame([("s", "b"), ("t", None)], "session_id string, project string")
    assert {(r.project, r.sessions, r.turns, r.agent_turns, r.input_tokens) for r in tree_report("a15_projects", t, own).collect()} == {("b", 1, 2, 1, 20), ("(unknown)", 1, 0, 0, 0)}


def test_longest_prefix(spark):
    names = [("claude-opus-4-6",), ("claude-opus-4-1-20250805",), ("claude-opus-4-20250514",), ("claude-opus-4-8[1m]",), ("x-1",)]
    got = {r.model: (r.price_key, r.source) for r in resolve(spark.createDataFrame(names, "model string")).collect()}
    assert got == {"claude-opus-4-6": ("claude-opus-4-6", "exact"), "claude-opus-4-1-20250805": ("claude-opus-4-1", "prefix"), "claude-opus-4-20250514": ("claude-opus-4", "prefix"), "claude-opus-4-8[1m]": ("claude-opus-4-8", "exact"), "x-1": ("claude-opus-4-8", "fallback")}


def test_known_cost(spark):
    t = spark.sql("select 'claude-opus-4-6' as model, 3500L as input_tokens, 1500L as output_tokens, 0L as cache_creation, 0L as cache_read, false as has_ttl, 0L as cw_5m, 0L as cw_1h")
    assert math.isclose(priced(t).first().cost / 1e9, 0.055)


def test_dedup(spark):
    cols = "session_id string, file_id long, is_agent boolean, request_id string, line_pos long, output_tokens long"
    t = spark.createDataFrame([("s", -1, False, "r1", 1, 10), ("s", -1, False, "r1", 2, 20), ("s", -1, False, None, 3, 5), ("s", -1, False, "", 4, 5), ("s", 1, True, "r1", 1, 7), ("s", 1, True, "r2", 2, 8)], cols)
    once = last_of_request(t)
    assert {(r.request_id, r.line_pos, r.output_tokens) for r in once.where("not is_agent").collect()} == {("r1", 1, 20), (None, 3, 5), ("", 4, 5)}
    assert [r.request_id for r in without_repeats_of_main(once).where("is_agent").collect()] == ["r2"]


def test_three_sessions(spark):
    """Three sessions of two projects, with every figure worked out by hand."""
    rows = [("11111111-a", "-Users-dev-alpha", "2025-03-10 10:00:00", "claude-opus-4-6", 1000, 500), ("11111111-a", "-Users-dev-alpha", "2025-03-10 10:05:00", "claude-opus-4-6", 2000, 800), ("11111111-a", "-Users-dev-alpha", "2025-03-12 14:00:00", "claude-opus-4-6", 500, 200), ("22222222-b", "-Users-dev-beta", "2025-03-15 09:00:00", "claude-sonnet-4-5", 3000, 1500), ("22222222-b", "-Users-dev-beta", "2025-03-15 09:30:00", "claude-sonnet-4-5", 1000, 400), ("33333333-c", "-Users-dev-alpha", "2025-04-02 11:00:00", "claude-opus-4-6", 800, 300)]
    t = spark.createDataFrame(rows, "session_id string, project string, at string, model string, input_tokens long, output_tokens long").withColumn("ts", F.to_timestamp("at"))
    t = t.selectExpr("*", "0L as cache_creation", "0L as cache_read", "false as has_ttl", "0L as cw_5m", "0L as cw_1h", "false as is_agent", "-1L as file_id", "monotonically_increasing_id() as line_pos", "'end_turn' as stop_reason", "array() as tool_names")
    get = lambda name, **k: tree_report(name, t, today="2025-04-03", **k).collect()
    total, rate = get("a04_overview_totals")[0], get("a12_efficiency")[0]
    assert (total.sessions, total.turns, total.context, total.output_tokens) == (3, 6, 8300, 3700) and math.isclose(total.cost_usd, 0.107)
    assert math.isclose(rate.output_ratio, 44.578313, rel_tol=1e-6) and rate.tokens_per_turn == 616
    i = get("a44_overview_insights")[0]
    assert (i.compactions, i.compacted_sessions, i.peak_context, i.days) == (2, 2, 3000, 23)
    assert {(r.label, r.sessions, r.turns) for r in get("a17_trend_monthly")} == {("2025-03", 2, 5), ("2025-04", 1, 1)}
    h = get("a20_heatmap_stats")[0]
    assert (h.total_days, h.active_days, h.current_streak, h.longest_streak, h.busiest_day) == (25, 4, 0, 1, "2025-03-15")
    assert {r.model: round(r.cost_usd, 4) for r in get("a03_overview_by_model")} == {"claude-opus-4-6": 0.0665, "claude-sonnet-4-5": 0.0405}
    assert [r.project for r in get("t01_top_projects")] == ["-Users-dev-alpha", "-Users-dev-beta"]
    # Another zone moves turns to another day; a session without turns counts as a session.
    assert {r.day for r in get("t07_active_days", timezone="Pacific/Kiritimati")} >= {"2025-03-11", "2025-03-13"}
    more = spark.createDataFrame([(k, "p") for k in ("11111111-a", "22222222-b", "33333333-c", "empty")], "session_id string, project string")
    assert get("a04_overview_totals", sessions=more)[0].sessions == 4


def test_streaks_and_thresholds(spark):
    days = spark.createDataFrame([(f"2025-01-0{d}", n) for d, n in ((1, 1), (2, 2), (3, 3), (5, 4), (6, 0))], "day string, turns long")
    assert max(r.length for r in streaks(days).collect()) == 3
    assert tuple(thresholds(days).first()) == (2, 3, 4)
    assert tuple(thresholds(days.where("turns < 0")).first()) == (1, 2, 3)


def test_chains_follow_the_latest_child(spark):
    """a-b-c-d; b has an older child x; y and z hang on a parent that is not there; one lone root."""
    edges = [("a", None, 1), ("b", "a", 2), ("x", "b", 3), ("c", "b", 4), ("d", "c", 5), ("y", "gone", 1), ("z", "y", 2), ("r", None, 9)]
    nodes = spark.createDataFrame([("s", u, p, t) for u, p, t in edges] + [("t", "a", None, 1)], "session string, uuid string, parent string, ts long")
    assert {(r.session, r.uuid, r.length) for r in chain_lengths(nodes).collect()} == {("s", "a", 4), ("s", "y", 2), ("s", "r", 1), ("t", "a", 1)}


def test_texts(spark):
    row = spark.sql("select 'héé日本x' as t, 12345678 as n, -1234500000000L as c, 0.5D as s, 59.5D as m, 125.2D as h, \"<a href='x'>&\" as e")
    cut = [row.select(truncate_bytes(F.col("t"), n)).first()[0] for n in (20, 10, 8, 6, 4)]
    assert cut == ["héé日本x", "héé...", "héé...", "hé...", "h..."]
    got = row.select(compact_number(F.col("n")), format_cost(F.col("c")), *(format_duration(F.col(c)) for c in "smh"), escape_html(F.col("e")), escape_script(F.lit("</script><!-- x"))).first()
    assert tuple(got) == ("12.35M", "-$1,234.50", "30s", "60m", "2h5m", "&lt;a href=&#x27;x&#x27;&gt;&amp;", "<\\/script><\\!-- x")


def test_configuration(spark):
    text = '[[subscription]]\nstart_date = "2026-01-01"\nmonthly_price_usd = 100.0\n[[subscription]]\nstart_date = "2026-03-01"\nmonthly_price_usd = 200.0\nplan = "max"\n[pricing_override.claude-x]\nbase_input = 1.0\ncache_write_5m = 1.25\ncache_write_1h = 2.0\ncache_read = 0.1\noutput = 5.0\n'
    subscriptions, overrides = load_config(text)
    assert [s["monthly_price_usd"] for s in subscriptions] == [100.0, 200.0] and overrides == {"claude-x": (1000, 1250, 2000, 100, 5000)}
    got = {r.model: (r.price_key, r.source, r.r_output) for r in resolve(spark.createDataFrame([("claude-x",), ("claude-x-9",), ("claude-opus-4-6",)], "model string"), overrides).collect()}
    assert got == {"claude-x": ("claude-x", "override exact", 5000), "claude-x-9": ("claude-x", "override prefix", 5000), "claude-opus-4-6": ("claude-opus-4-6", "exact", 25000)}


def test_one_session_by_prefix(spark):
    from tallyloom.plans.registry import facts
    from tallyloom.plans.reports import one_session
    from tallyloom.sources.adapters import raw_turns_from_events, raw_turns_from_lineitem

    f = facts(raw_turns_from_events(spark, SF))
    full = f.all_sessions.first().session_id
    assert one_session(f, full) == full
    for prefix in ("s", "nothing"):
        with pytest.raises(LookupError):
            one_session(f, prefix)
    lines = facts(raw_turns_from_lineitem(spark, SF))
    assert lines.turns.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()


def test_prices_need_no_join(spark):
    """One scan and one exchange: the price is a column expression."""
    plan = QUERIES["a03_overview_by_model"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_payloads_hold_the_reports(spark, tmp_path):
    import json

    from tallyloom.plans import payloads

    get = {n: json.loads(QUERIES[n](spark, SF).first().json) for n in QUERIES if n.startswith("k0") and n not in ("k02_session_json", "k08_dashboard_sessions")}
    o = get["k01_overview_json"]
    assert [m["cost_usd"] for m in o["models"]] == sorted((m["cost_usd"] for m in o["models"]), reverse=True) and len(o["hours"]) == 24
    assert math.isclose(sum(m["cost_usd"] for m in o["models"]), o["total_cost_usd"]) and math.isclose(sum(o["cost_by_category"].values()), o["total_cost_usd"])
    assert sum(p["sessions"] for p in get["k03_projects_json"]["projects"]) == o["total_sessions"]
    assert sum(e["turns"] for e in get["k04_trend_json"]["entries"]) == o["total_turns"] and get["k04_trend_json"]["group_label"] == "Day"
    assert get["k05_wrapped_json"]["turns"] == o["total_turns"] and len(get["k05_wrapped_json"]["extremes"]) == 2
    h = get["k06_heatmap_json"]
    assert len(h["daily"]) == h["stats"]["totalDays"] and len(h["thresholds"]) == 3 and [d["date"] for d in h["daily"]] == sorted(d["date"] for d in h["daily"])
    d = get["k07_dashboard_json"]
    assert all(x["turns"] + x["sessions"] > 0 for x in d["heatmap"]) and d["overview"]["sessions"] == o["total_sessions"]
    s = QUERIES["k02_session_json"](spark, SF).orderBy("session_id").first()
    one = json.loads(s.json)
    assert one["session_id"] == s.session_id and [t["turn_number"] for t in one.get("turns", [])] == list(range(1, one.get("turn_count", 0) + 1))
    payloads.write(QUERIES["k03_projects_json"](spark, SF), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == get["k03_projects_json"]
