"""Prefix joins, table sorts, cycles and buckets of chains, and how often reports read the records."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import pricing
from tallyloom.functions.pricing import resolve
from tallyloom.operators.graph import bucketed, chain_lengths, cycles
from tallyloom.operators.ordering import next_sort, sort_table
from tallyloom.operators.prefixes import longest_prefix
from tallyloom.plans import payloads
from tallyloom.plans.registry import QUERIES, facts
from tallyloom.plans.reports import REPORTS, Facts
from tallyloom.sources import transcripts as T
from tallyloom.sources.adapters import raw_turns_from_events

from .test_transcripts import MAIN, home, read  # noqa: F401

SF = "/root/testdata/sf0.001"


def scans(df):
    return len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_longest_prefix_equals_a_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    keys = sorted({word(rng.randrange(7)) for _ in range(60)})
    values = [None, "", *(word(rng.randrange(12)) for _ in range(200))]
    table = spark.createDataFrame([(k, n) for n, k in enumerate(keys)] + [(None, -1)], "k string, n int")
    got = longest_prefix(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int"), F.col("v"), table, "k").collect()
    want = [max((k for k in keys if v is not None and v.startswith(k)), key=len, default=None) for v in values]
    assert {r.i: (r.k, r.n) for r in got} == {i: (k, None if k is None else keys.index(k)) for i, k in enumerate(want)}


def test_many_override_prices(spark, monkeypatch):
    """The join says what the conditions say, and ten thousand overrides make no larger plan than a few."""
    names = ["claude-opus-4-6", "claude-opus-4-1-20250805", "claude-opus-4-8[1m]", "x-1", "x-12-b", "own", "own-large-2", None]
    models = spark.createDataFrame([(n,) for n in names], "model string")
    overrides = {"claude-opus-4": (1, 2, 3, 4, 5), "claude-opus-4-1": (2, 2, 2, 2, 2), "own": (3, 3, 3, 3, 3), "own-large": (4, 4, 4, 4, 4), "x-12": (5, 5, 5, 5, 5), "claude-opus-4-6": (6, 6, 6, 6, 6)}
    want = sorted(map(str, resolve(models, overrides).collect()))
    monkeypatch.setattr(pricing, "CHAIN", 0)
    assert sorted(map(str, resolve(models, overrides).collect())) == want
    many = overrides | {f"zz-{k}": (k, k, k, k, k) for k in range(10_000)}
    assert sorted(map(str, resolve(models, many).collect())) == want
    size = lambda o: len(resolve(models, o)._jdf.queryExecution().executedPlan().toString())
    assert size(many) < 1.05 * size(overrides) + 200


def test_table_sort(spark):
    df = spark.createDataFrame([("b", 10, 1), ("A", 9, 2), ("a", 100, 3), ("é", None, 4), ("f", 2, 5), (None, 3, 6)], "name string, n int, i int")
    order = lambda *a: [r.i for r in sort_table(df, *a, "i").collect()]
    assert order("name", "asc") == [3, 2, 1, 4, 5, 6] and order("name", "desc") == [5, 4, 1, 2, 3, 6]
    assert order("n", "asc") == [5, 6, 2, 1, 3, 4] and order("n", "desc") == [3, 1, 2, 6, 5, 4]
    assert sort_table(df, None, None) is df
    state, seen = (None, None), []
    for clicked in ("n", "n", "n", "n", "name", "name"):
        state = next_sort(*state, clicked)
        seen.append(state)
    assert seen == [("n", "desc"), ("n", "asc"), (None, None), ("n", "desc"), ("name", "desc"), ("name", "asc")]
    assert next_sort("n", "asc", "name", sortable=False) == ("n", "asc")


def test_cycles_and_chain_buckets(spark):
    nodes = [("s", f"n{k}", f"n{k - 1}" if k else None, k) for k in range(12)] + [("s", "a", "c", 1), ("s", "b", "a", 2), ("s", "c", "b", 3), ("s", "hang", "a", 4), ("s", "hang2", "hang", 5), ("s", "lost", "gone", 6), ("t", "self", "self", 1), ("t", "x", None, 2)]
    df = spark.createDataFrame(nodes, "session string, uuid string, parent string, ts int")
    assert {tuple(r) for r in cycles(df).collect()} == {("s", "a"), ("s", "b"), ("s", "c"), ("s", "hang"), ("s", "hang2"), ("t", "self")}
    assert {tuple(r) for r in chain_lengths(df).collect()} == {("s", "n0", 12), ("s", "lost", 1), ("t", "x", 1)}
    got = {r.bucket: r.n for r in bucketed(chain_lengths(df), "length").collect()}
    assert got == {"0..1": 2, "2..10": 0, "11..50": 1, "51..200": 0, "201..1000": 0, ">1000": 0}


@pytest.mark.parametrize("name", ["a21_wrapped", "a20_heatmap_stats", "a19_heatmap_days", "f10_heatmap_window", "a17_trend_daily", "h06_calendar_grid"])
def test_reports_in_one_pass(spark, name):
    """A report of days, hours and sessions reads the records once (the calendar's grid: once for its first day)."""
    allowed = {"h06_calendar_grid": 2}.get(name, 1)
    assert scans(QUERIES[name](spark, SF)) <= allowed


@pytest.mark.parametrize("name", ["k01_overview_json", "k07_dashboard_json"])
def test_payloads_read_written_records(spark, monkeypatch, name):
    """All parts come from one table of the records: the plan scans no file again, and says what it says without."""
    df = QUERIES[name](spark, SF)
    if spark.conf.get("spark.checkpoint.dir", None):
        assert scans(df) == 0
    monkeypatch.setattr(Facts, "written", lambda self: self)
    assert df.first().json == QUERIES[name](spark, SF).first().json


def test_session_payload_of_a_tree(spark, home, read):  # noqa: F811
    files, entries, _, turns = read
    meta = T.agent_meta(spark, home)
    agents = T.subagents(files, turns, meta)
    more = payloads.extras(T.sessions(files, turns), T.metadata(entries), T.hooks(entries), T.subagent_types(agents), T.workflow_runs(spark, home, agents))
    from tallyloom.plans.registry import for_reports

    own = T.sessions(files, turns).select("session_id", "project")
    got = {r.session_id: json.loads(r.json) for r in payloads.session(Facts(for_reports(turns), own, "2026-06-01"), more).collect()}
    s = got[MAIN]
    assert (s["title"], s["tags"], s["is_orphan"], s["turn_count"]) == ("mine", ["b", "a"], False, 7)
    assert [h["command"] for h in s["hooks"]] == ["fmt"] and {t["agent_type"] for t in s["subagent_types"]} == {"builder", "unknown"}
    assert {w["run_id"]: w.get("workflow") for w in s["workflows"]}["wf_1"] == "build" and s["plugins"][0]["plugin"] == "superpowers"


def test_subscription_in_the_overview(spark):
    f = facts(raw_turns_from_events(spark, SF))
    value = json.loads(payloads.overview(f, 100.0).first().json)["subscription_value"]
    assert value["monthly_usd"] == 100.0 and value["multiplier"] == pytest.approx(value["api_usd"] / 100)
    assert set(REPORTS) >= {"t08_table_sort", "x16_price_age", "x25_archetypes"}


def test_titles_and_prompts_of_a_tree(spark, home, read):  # noqa: F811
    """A session is found by its title; autonomy is turns a user prompt, over the sessions of the year."""
    from tallyloom.plans.registry import for_reports
    from tallyloom.plans.reports import session_search, wrapped

    files, entries, _, turns = read
    f = Facts(for_reports(turns), T.sessions(files, turns).select("session_id", "project"), "2026-06-01")
    meta = T.metadata(entries)
    assert [r.session_id for r in session_search(f, "MINE", "opus", meta).collect()] == [MAIN] and session_search(f, "MINE", "opus").count() == 0
    row = wrapped(f, 2026, meta).first()
    assert (row.turns, row.user_prompts, row.autonomy_ratio) == (8, 2, 4.0)
    assert wrapped(f, 2020, meta).first().autonomy_ratio == 0.0
