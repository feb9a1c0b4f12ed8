"""Reports as JSON, one string a row; sinks write them as text. Lists are aggregates of a report's rows, which a report bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_script
from . import reports as R


def _list(df: DataFrame, name: str, *order: str, most: int | None = None) -> DataFrame:
    """One row: the rows of df as an array of structs, ordered by columns ('-x': falling)."""
    if most is not None:
        df = df.orderBy(*(F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order)).limit(most)
    rows = F.collect_list(F.struct(*df.columns))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for o in reversed(order):
            x, y = (a, b) if o[0] != "-" else (b, a)
            n = o.lstrip("-")
            out = F.when(x[n] < y[n], -1).when(x[n] > y[n], 1).otherwise(out)
        return out

    return df.agg((F.array_sort(rows, compare) if order else rows).alias(name))


def _together(*rows: DataFrame) -> DataFrame:
    """One row of the columns of frames that have one row each."""
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)
    return out


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def overview(f: R.Facts, subscription_usd: float | None = None) -> DataFrame:
    """Totals, models by cost, at most 20 tools, cost by category, hours, cache savings, warnings, and what a subscription is worth if its price is given."""
    f = f.written()
    total = R.overview_totals(f).select(*(F.col(c).alias(f"total_{c}") for c in ("sessions", "turns", "agent_turns", "output_tokens", "context", "cost_usd")))
    worth = [R.subscription_value(f, subscription_usd).select(F.struct("*").alias("subscription_value"))] if subscription_usd else []
    return _json(_together(
        *worth, total, R.efficiency(f), R.cache_hit_rate(f), R.cost_by_category(f).select(F.struct("cost_input", (F.col("cost_5m") + F.col("cost_1h")).alias("cache_write"), "cost_read", "cost_output").alias("cost_by_category")),
        _list(R.overview_by_model(f), "models", "-cost_usd", "model"), _list(R.tools(f), "top_tools", "-uses", "tool", most=20), _list(R.hours(f), "hours", "hour"),
        R.cache_savings_total(f).select(F.struct("*").alias("cache_savings")), _list(R.pricing_warnings(f), "pricing_warnings", "-cost_usd", "requested"),
    ))


def session(f: R.Facts, more: DataFrame | None = None) -> DataFrame:
    """(session_id, json): each session with its turns in order, its histograms, plugins, skills and agents; the hit rate is read tokens over context tokens.

    more: further columns by session_id (extras() of a transcript tree), null where a session has none.
    """
    f = f.written()
    detail = R.turn_detail(f)
    names = [c for c in detail.columns if c != "session_id"]
    turns = detail.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("turns"), F.count("*").alias("turn_count"), R.share(F.sum("cache_read"), F.sum("context")).alias("cache_hit_rate"))
    counts = R.session_histograms(f).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("kind", "value", F.col("turns").alias("n")))).alias("counts"))
    s = R.session_totals(f).join(turns, "session_id", "left").join(counts, "session_id", "left")
    for name, part in (("plugins", R.plugin_usage(f)), ("skills", R.skill_usage(f)), ("subagents", R.agent_summary(f))):
        s = s.join(_by_session(part, name), "session_id", "left")
    if more is not None:
        s = s.join(more, "session_id", "left")
    return s.select("session_id", F.to_json(F.struct(*s.columns)).alias("json"))


def _by_session(df: DataFrame, name: str) -> DataFrame:
    """(session_id, name): the other columns of a session's rows as a sorted array."""
    return df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c != "session_id")))).alias(name))


def extras(sessions: DataFrame, metadata: DataFrame, hooks: DataFrame, types: DataFrame, runs: DataFrame) -> DataFrame:
    """What the tables of a transcript tree say of a session besides turns: title, tags, is_orphan, hooks, subagent types, workflows."""
    out = sessions.select("session_id", "is_orphan").join(metadata.select("session_id", "title", "tags"), "session_id", "left")
    plain = runs.select("session_id", "run_id", "workflow", "status", "duration_ms", "agents", "turns", "output_tokens", "tokens", (F.col("cost") / 1e9).alias("cost_usd"))
    for name, part in (("hooks", hooks), ("subagent_types", types.select("session_id", "agent_type", "agents", "turns", "output_tokens", (F.col("cost") / 1e9).alias("cost_usd"))), ("workflows", plain)):
        out = out.join(_by_session(part, name), "session_id", "left")
    return out


def projects(f: R.Facts, top_n: int = 0) -> DataFrame:
    return _json(_list(R.projects(f, top_n), "projects", "-cost_usd", "project"))


def trend(f: R.Facts, days: int = 0, monthly: bool = False) -> DataFrame:
    return _json(_list(R.trend(f, days, monthly), "entries", "date").withColumn("group_label", F.lit("Month" if monthly else "Day")))


def wrapped(f: R.Facts, year: int = R.YEAR, prompts: DataFrame | None = None) -> DataFrame:
    lists = (_list(R.wrapped_top_projects(f), "top_projects", "-cost_usd", "display"), _list(R.wrapped_top_tools(f), "top_tools", "-uses", "tool"), _list(R.model_distribution(f), "model_distribution", "-turns", "model"), _list(R.wrapped_extremes(f), "extremes", "kind"))
    return _json(_together(R.wrapped(f, year, prompts), *lists))


def heatmap(f: R.Facts, days: int = 0) -> DataFrame:
    """Every day of the window, the thresholds as an array, and the statistics, with names in camel case."""
    d = f.calendar_days(days)
    daily = d.select(F.col("day").alias("date"), "turns", R.usd("cost").alias("cost"), "sessions")
    stats = R.heatmap_stats(f, days).select(F.struct(F.col("total_days").alias("totalDays"), F.col("active_days").alias("activeDays"), F.col("current_streak").alias("currentStreak"), F.col("longest_streak").alias("longestStreak"), F.col("busiest_day").alias("busiestDay")).alias("stats"))
    ends = d.agg(F.min("day").alias("startDate"), F.max("day").alias("endDate"))
    return _json(_together(ends, _list(daily, "daily", "date"), R.thresholds(d).select(F.array("p25", "p50", "p75").alias("thresholds")), stats))


def dashboard_sessions(f: R.Facts) -> DataFrame:
    """One row a session for the dashboard: the whole id, and no hit rate where there is no context."""
    s = R.session_summaries(f)
    return s.withColumn("cache_hit_rate", F.when(F.col("context") > 0, F.col("cache_hit_rate"))).drop("id8")


def dashboard(f: R.Facts, escaped: bool = False) -> DataFrame:
    """What the dashboard shows in one payload; its heatmap has active days only. escaped: fit for a script element.

    Its list of sessions grows without bound, so it is no part of this one row but rows of dashboard_sessions().
    """
    f = f.written()
    parts = (
        R.overview_totals(f).select(F.struct("*").alias("overview")), _list(R.overview_by_model(f), "models", "-cost_usd", "model"), _list(R.projects(f, 20), "projects", "-cost_usd", "project"), _list(R.trend(f), "trend", "date"),
        _list(R.active_days(f), "heatmap", "day"), R.wrapped(f).select(F.struct("*").alias("wrapped")),
    )
    out = _json(_together(*parts))
    return out.select(escape_script(F.col("json")).alias("json")) if escaped else out


PAYLOADS = {"k01_overview_json": overview, "k02_session_json": session, "k03_projects_json": projects, "k04_trend_json": trend, "k05_wrapped_json": wrapped, "k06_heatmap_json": heatmap, "k07_dashboard_json": dashboard, "k08_dashboard_sessions": dashboard_sessions}


def write(payload: DataFrame, path: str) -> None:
    """A payload's JSON as text files."""
    payload.select("json").write.mode("overwrite").text(path)
