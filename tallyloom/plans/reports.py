"""The reports, as DataFrames over turns and sessions. Money stays in whole nano-dollars until the last projection.

Keys name the operator of the inventory that a report is. Windows without a partition key run only over one row a
calendar day, or over a histogram; everything else is grouped with map-side sums.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import PRICES, RATES, price_age
from ..functions.scalars import archetype, archetype_text, compact_number, escape_html, format_cost, format_duration, format_number, heat_glyph, project_display_name, short_model, truncate_bytes
from ..operators.ordering import sort_columns
from ..operators.selection import select_places

ORDER = ("ts", "file_id", "line_pos")
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
NIGHT = "hour >= 22 or hour < 6"


@dataclass
class Facts:
    """turns: priced, with calendar columns; all_sessions: (session_id, project) of every session, without turns too; today: a date literal."""

    turns: DataFrame
    all_sessions: DataFrame
    today: str
    base: DataFrame | None = None  # what turns come from, with the records that are none: one pass tells turns and sessions

    @property
    def ordered(self) -> DataFrame:
        """Turns with what their session's order says: number, context of the turn before, whether context was compacted."""
        w = Window.partitionBy("session_id").orderBy(*ORDER)
        t = self.turns.withColumn("turn_number", F.row_number().over(w).cast("long")).withColumn("before", F.lag("context").over(w))
        return t.withColumn("is_compaction", F.coalesce((F.col("before") > 0) & (F.col("context") * 10 < F.col("before") * 9), F.lit(False)))

    @property
    def sessions(self) -> DataFrame:
        """One row a session, with zeros and no times where it has no turns."""
        flag = lambda c: F.count_if(c)
        per = self.ordered.groupBy("session_id").agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("turns"), flag(F.col("is_agent")).alias("agent_turns"),
            *(F.sum(c).alias(c) for c in ("output_tokens", "context", "cache_read", "cost")), F.sum(F.when(F.col("has_ttl"), F.col("cw_5m"))).alias("cw_5m"), F.sum(F.when(F.col("has_ttl"), F.col("cw_1h"))).alias("cw_1h"),
            F.max("context").alias("max_context"), flag(F.col("is_compaction")).alias("compactions"), flag(F.col("stop_reason") == "tool_use").alias("tool_use_stops"), flag(F.col("stop_reason") == "max_tokens").alias("truncated"),
        )
        s = self.all_sessions.join(per, "session_id", "left").fillna(0, [c for c in per.columns if c not in ("session_id", "first_ts", "last_ts")])
        return s.withColumns({
            "display": F.coalesce(project_display_name(F.col("project")), F.lit("(unknown)")),
            "minutes": F.coalesce(F.expr("(unix_micros(last_ts) - unix_micros(first_ts)) div 1000000 / 60D"), F.lit(0.0)),
            "start_day": F.date_format("first_ts", "yyyy-MM-dd"),
        })

    @property
    def days(self) -> DataFrame:
        """One row an active day."""
        return self.turns.groupBy("day").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum("context").alias("context"), F.sum("cost").alias("cost"))

    @property
    def starts(self) -> DataFrame:
        return self.sessions.where("start_day is not null").groupBy(F.col("start_day").alias("day")).agg(F.count("*").alias("sessions"))

    def written(self) -> Facts:
        """The same facts over base as a table, for payloads of many reports: the records are read once.

        In the shared folder where the session names one in spark.checkpoint.dir, else kept on the executors' disks.
        """
        if self.base is None:
            return self
        spark = self.base.sparkSession
        if at := spark.conf.get("spark.checkpoint.dir", None):
            spark.sparkContext.setCheckpointDir(at)
            base = self.base.checkpoint()
        else:
            base = self.base.persist(StorageLevel.DISK_ONLY)
        return Facts(base.where("kept").drop("kept", "named"), base.groupBy("session_id").agg(F.min("named").alias("project")), self.today, base)

    @property
    def hours(self) -> DataFrame:
        """One row an hour in which a session has turns, and one without an hour for a session's records that are none, in one pass.

        Each with the session's first and last turn and its project, by a window over a session's hours, of which
        the calendar bounds the number, and not over its turns.
        """
        base = self.base
        if base is None:
            base = self.turns.withColumn("kept", F.lit(True)).unionByName(self.all_sessions.select("session_id", F.col("project").alias("named"), F.lit(False).alias("kept")), allowMissingColumns=True)
        own = lambda c: F.when(F.col("kept"), F.col(c))
        names = ("input_tokens", "output_tokens", "cache_creation", "cache_read", "context", "cost", "cost_input", "cost_5m", "cost_1h", "cost_read", "cost_output")
        per = base.groupBy("session_id", *(own(c).alias(c) for c in ("day", "hour", "dow"))).agg(
            F.count_if("kept").alias("turns"), F.count_if(F.col("kept") & F.col("is_agent")).alias("agent_turns"), *(F.coalesce(F.sum(own(c)), F.lit(0)).alias(c) for c in names),
            F.min(own("ts")).alias("first_ts"), F.max(own("ts")).alias("last_ts"), F.min("named").alias("named"),
        )
        w = Window.partitionBy("session_id")
        return per.withColumns({"session_first": F.min("first_ts").over(w), "session_last": F.max("last_ts").over(w), "project": F.min("named").over(w)}).drop("named")

    def calendar_days(self, days: int = 0) -> DataFrame:
        """One row for every day up to today: all since the first session (days 0) or the last `days`; days without turns are 0.

        Days are grouped once; a session counts on the day of its first turn. The days in between come from each
        day and the next one, over one row a calendar day.
        """
        today = dt.date.fromisoformat(self.today)
        ends = [self.today] + ([(today - dt.timedelta(days - 1)).isoformat()] if days else [])
        sums = ("turns", "cost", "output_tokens", "context")
        active = self.hours.where("hour is not null").groupBy("day").agg(*(F.sum(c).alias(c) for c in sums), F.count_if(F.col("first_ts") == F.col("session_first")).alias("sessions"))
        edge = self.turns.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ends))).alias("day"), *(F.lit(0).cast("long").alias(c) for c in (*sums, "sessions")))
        d = active.unionByName(edge).groupBy("day").agg(*(F.sum(c).alias(c) for c in (*sums, "sessions")))
        if days:
            d = d.where(F.col("day").between(ends[1], ends[0]))
        else:
            first = F.min(F.when(F.col("sessions") > 0, F.col("day"))).over(Window.partitionBy())
            d = d.withColumn("first", first).where(F.col("day") <= self.today).where("first is null or first <= '" + self.today + "'")
        after = F.lead("day").over(Window.orderBy("day"))
        span = F.sequence(F.col("day").cast("date"), F.coalesce(F.date_sub(after.cast("date"), 1), F.col("day").cast("date")))
        out = d.select(*sums, "sessions", span.alias("span")).select("*", F.posexplode("span").alias("n", "date"))
        return out.select(F.date_format("date", "yyyy-MM-dd").alias("day"), *(F.when(F.col("n") == 0, F.col(c)).otherwise(0).alias(c) for c in (*sums, "sessions")))


REPORTS: dict[str, Callable[[Facts], DataFrame]] = {}


def report(name: str):
    def add(f):
        REPORTS[name] = f
        return f

    return add


def usd(c: Column | str) -> Column:
    return F.col(c) / 1e9 if isinstance(c, str) else c / 1e9


def share(part: Column, whole: Column, of: float = 1e2) -> Column:
    """part / whole, times 100 or what `of` says; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(of) / whole)


def tokens() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation", "cache_read")]


def money() -> Column:
    return usd(F.sum("cost")).alias("cost_usd")


def first_of(df: DataFrame, keys: list[str], *order: Column | str, rows: int = 1, rank: str | None = None) -> DataFrame:
    """The first rows of each group, with their rank if it is named."""
    out = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= rows)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


# Overview


@report("a03_overview_by_model")
def overview_by_model(f: Facts) -> DataFrame:
    return f.turns.groupBy("model").agg(F.count("*").alias("turns"), *tokens(), money())


@report("a04_overview_totals")
def overview_totals(f: Facts) -> DataFrame:
    t = f.turns.agg(F.count("*").alias("turns"), F.count_if("is_agent").alias("agent_turns"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("output_tokens", "context", "cost")))
    return f.all_sessions.agg(F.count("*").alias("sessions")).crossJoin(t).select("sessions", "turns", "agent_turns", "output_tokens", "context", usd("cost").alias("cost_usd"))  # one row each


@report("a05_cost_by_category")
def cost_by_category(f: Facts) -> DataFrame:
    return f.turns.agg(*(usd(F.sum(c)).alias(c) for c in ("cost_input", "cost_5m", "cost_1h", "cost_read", "cost_output")))


@report("a06_hours")
def hours(f: Facts) -> DataFrame:
    grid = f.turns.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return grid.join(f.turns.groupBy("hour").agg(F.count("*").alias("turns")), "hour", "left").fillna(0, ["turns"])


@report("a07_weekday_hours")
def weekday_hours(f: Facts) -> DataFrame:
    grid = f.turns.sparkSession.range(168).select((F.col("id") % 7).cast("int").alias("dow"), F.expr("cast(id div 7 as int)").alias("hour"))
    return grid.join(f.turns.groupBy("dow", "hour").agg(F.count("*").alias("turns")), ["dow", "hour"], "left").fillna(0, ["turns"])


def tool_uses(f: Facts, *by: str) -> DataFrame:
    """Every use counts, several in one turn too."""
    return f.turns.select(*by, F.explode("tool_names").alias("tool")).groupBy(*by, "tool").agg(F.count("*").alias("uses"))


@report("a08_tools")
def tools(f: Facts) -> DataFrame:
    return tool_uses(f)


@report("a09_cache_hit_rate")
def cache_hit_rate(f: Facts) -> DataFrame:
    return f.turns.agg(share(F.coalesce(F.sum("cache_read"), F.lit(0)), F.coalesce(F.sum("context"), F.lit(0))).alias("cache_hit_rate"))


def savings(f: Facts) -> DataFrame:
    return f.turns.groupBy("model").agg(F.sum(F.col("cache_read") * F.col("r_input")).alias("without"), F.sum("cost_read").alias("with"))


@report("a10_cache_savings")
def cache_savings(f: Facts) -> DataFrame:
    return savings(f).select("model", (F.col("without") - F.col("with")).alias("saved")).where("saved > 10000000").select("model", usd("saved").alias("saved_usd"))


@report("a10_cache_savings_total")
def cache_savings_total(f: Facts) -> DataFrame:
    s = savings(f).agg(F.coalesce(F.sum("without"), F.lit(0)).alias("w"), F.coalesce(F.sum("with"), F.lit(0)).alias("a"))
    return s.select(usd(F.col("w") - F.col("a")).alias("saved_usd"), usd("w").alias("without_usd"), usd("a").alias("with_usd"), share(F.col("w") - F.col("a"), F.col("w")).alias("saved_percent"))


@report("a11_subscription_value")
def subscription_value(f: Facts, monthly_usd: float = 200.0) -> DataFrame:
    cost = f.turns.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))
    return cost.select(F.lit(monthly_usd).alias("monthly_usd"), usd("cost").alias("api_usd"), (usd("cost") / monthly_usd).alias("multiplier"))


@report("a12_efficiency")
def efficiency(f: Facts) -> DataFrame:
    t = f.turns.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("output_tokens", "context", "cost")), F.count("*").alias("n"))
    return t.select(share(F.col("output_tokens"), F.col("context")).alias("output_ratio"), share(usd("cost"), F.col("n"), 1.0).alias("cost_per_turn"), F.coalesce(F.expr("try_divide(output_tokens - output_tokens % nullif(n, 0), n)"), F.lit(0)).cast("long").alias("tokens_per_turn"))


@report("a13_pricing_warnings")
def pricing_warnings(f: Facts) -> DataFrame:
    return f.turns.where("source = 'fallback'").groupBy(F.col("bare_model").alias("requested")).agg(F.min("price_key").alias("used"), F.count("*").alias("turns"), money())


@report("a14_session_summaries")
def session_summaries(f: Facts) -> DataFrame:
    top = first_of(tool_uses(f, "session_id"), ["session_id"], F.desc("uses"), "tool", rows=5, rank="place")
    top = top.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "tool", "uses"))), lambda x: F.concat(x["tool"], F.lit(":"), x["uses"])), ",").alias("top_tools"))
    return f.sessions.join(session_primary_model(f).select("session_id", "model"), "session_id", "left").join(top, "session_id", "left").select(
        "session_id", F.substring("session_id", 1, 8).alias("id8"), "display", "minutes", F.coalesce("model", F.lit("")).alias("model"), "turns", "agent_turns", "output_tokens", "context", "max_context",
        share(F.col("cache_read"), F.col("context")).alias("cache_hit_rate"), share(F.col("cw_5m"), F.col("cw_5m") + F.col("cw_1h")).alias("share_5m"), "compactions", usd("cost").alias("cost_usd"), "tool_use_stops",
        F.coalesce("top_tools", F.lit("")).alias("top_tools"), share(F.col("output_tokens"), F.col("context")).alias("output_ratio"), share(usd("cost"), F.col("turns"), 1.0).alias("cost_per_turn"),
    )


def primary_model(f: Facts, key: str) -> DataFrame:
    counts = f.turns.groupBy(key, "model").agg(F.count("*").alias("turns"))
    return first_of(counts, [key], F.desc("turns"), "model").select(key, "model", "turns")


@report("a16_session_primary_model")
def session_primary_model(f: Facts) -> DataFrame:
    return primary_model(f, "session_id")


@report("a16_project_primary_model")
def project_primary_model(f: Facts) -> DataFrame:
    return primary_model(f, "project")


@report("t02_session_top_tools")
def session_top_tools(f: Facts) -> DataFrame:
    return first_of(tool_uses(f, "session_id"), ["session_id"], F.desc("uses"), "tool", rows=5, rank="place")


@report("a44_overview_insights")
def overview_insights(f: Facts) -> DataFrame:
    """Daily average over whole days between first and last turn (1 at least), compactions, peak context, mean minutes of sessions that last."""
    s = f.sessions.agg(F.sum("cost").alias("cost"), F.min("first_ts").alias("a"), F.max("last_ts").alias("b"), F.sum("compactions").alias("compactions"), F.count_if(F.col("compactions") > 0).alias("compacted_sessions"), F.max("max_context").alias("peak_context"), F.sum(F.expr("case when minutes > 0 then (unix_micros(last_ts) - unix_micros(first_ts)) div 1000000 end")).alias("secs"), F.count_if(F.col("minutes") > 0).alias("lasting"))
    days = F.greatest(F.lit(1), F.expr("(unix_micros(b) - unix_micros(a)) div 86400000000"))
    return s.select(days.cast("long").alias("days"), (usd("cost") / days).alias("daily_usd"), "compactions", "compacted_sessions", "peak_context", share(F.coalesce("secs", F.lit(0)) / 60.0, F.col("lasting"), 1.0).alias("mean_minutes"))


@report("a44_top_sessions")
def top_sessions(f: Facts) -> DataFrame:
    s = f.sessions.orderBy(F.desc("cost"), "session_id").limit(3)
    return s.select(F.substring("session_id", 1, 8).alias("id8"), truncate_bytes(F.col("display"), 25).alias("project"), "turns", format_duration(F.col("minutes")).alias("duration"), format_cost(F.col("cost")).alias("cost"))


# Projects


@report("a15_projects")
def projects(f: Facts, top_n: int = 0, project: str | None = None) -> DataFrame:
    """Every session counts for its project, without turns too, and every turn for the project that its own record names,
    where that is some session's. top_n 0: all; project: only names that hold it (the raw name, case counts)."""
    named = F.coalesce("project", F.lit("(unknown)")).alias("project")
    per, turns = f.all_sessions.groupBy(named).agg(F.count("*").alias("sessions")), f.turns.withColumn("project", named)
    if project is not None:
        per, turns = (d.where(F.contains("project", F.lit(project))) for d in (per, turns))
    sums = turns.groupBy("project").agg(F.count("*").alias("turns"), F.count_if("is_agent").alias("agent_turns"), *tokens(), F.sum("cost").alias("cost"))
    out = per.join(sums, "project", "left").fillna(0, [c for c in sums.columns if c != "project"])
    out = out.join(primary_model(Facts(turns, f.all_sessions, f.today), "project").select("project", "model"), "project", "left")
    out = out.select("project", project_display_name(F.col("project")).alias("display"), "sessions", "turns", "agent_turns", "input_tokens", "output_tokens", "cache_creation", "cache_read", usd("cost").alias("cost_usd"), F.coalesce("model", F.lit("")).alias("primary_model"))
    return out.orderBy(F.desc("cost_usd"), "project").limit(top_n) if top_n else out


@report("t01_top_projects")
def top_projects(f: Facts) -> DataFrame:
    return projects(f, top_n=5)


@report("f06_projects_by_name")
def projects_by_name(f: Facts) -> DataFrame:
    return projects(f, project="proj1")


@report("p19_project_sessions")
def project_sessions(f: Facts) -> DataFrame:
    """Sessions with turns by display name, each with its project's cache rate and its place by cost (J12)."""
    s = f.sessions.where("turns > 0")
    rate = s.groupBy("display").agg(share(F.sum("cache_read"), F.sum("context")).alias("project_cache_rate"))
    placed = s.withColumn("place", F.row_number().over(Window.partitionBy("display").orderBy(F.desc("cost"), "session_id")).cast("long"))
    return placed.join(rate, "display").select("display", "session_id", "turns", usd("cost").alias("cost_usd"), "place", "project_cache_rate")


# Sessions


@report("f07_sessions_by_prefix")
def sessions_by_prefix(f: Facts, prefix: str = "s0001-") -> DataFrame:
    return f.sessions.where(F.startswith("session_id", F.lit(prefix))).select("session_id", "turns")


def one_session(f: Facts, prefix: str) -> str:
    """The id that a prefix names; none or several are errors."""
    found = [r.session_id for r in sessions_by_prefix(f, prefix).limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} session begins with {prefix!r}")
    return found[0]


@report("f12_session_search")
def session_search(f: Facts, text: str = "PROJ3", family: str = "opus", titles: DataFrame | None = None) -> DataFrame:
    """Sessions whose id, project or title holds the text in any case and whose main model is of the family. titles: (session_id, title), from a tree's metadata()."""
    s = f.sessions.join(session_primary_model(f).select("session_id", "model"), "session_id")
    low = F.lit(text.lower())
    own = F.contains(F.lower("session_id"), low) | F.contains(F.lower("display"), low)
    if titles is not None:
        s = s.join(titles.select("session_id", "title"), "session_id", "left")
        own = own | F.coalesce(F.contains(F.lower("title"), low), F.lit(False))
    return s.where(own & (F.split(short_model(F.col("model")), "-")[0] == family)).select("session_id", "display", "model")


@report("w06_turn_detail")
def turn_detail(f: Facts) -> DataFrame:
    own = F.when(F.col("has_ttl"), F.coalesce("cw_5m", F.lit(0))).otherwise(0), F.when(F.col("has_ttl"), F.coalesce("cw_1h", F.lit(0))).otherwise(0)
    return f.ordered.select(
        "session_id", "turn_number", F.date_format("ts", STAMP).alias("ts"), "model", "input_tokens", "output_tokens", own[0].cast("long").alias("cache_write_5m"), own[1].cast("long").alias("cache_write_1h"), "cache_read", "context", share(F.col("cache_read"), F.col("context")).alias("cache_hit_rate"),
        usd("cost").alias("cost_usd"), *(usd(c).alias(c) for c in ("cost_input", "cost_5m", "cost_1h", "cost_read", "cost_output")), "stop_reason", "is_agent", "is_compaction", F.coalesce(F.col("context") - F.col("before"), F.lit(0)).alias("context_delta"), F.array_join("tool_names", ",").alias("tools"),
    )


@report("w01_compactions")
def compactions(f: Facts) -> DataFrame:
    return f.ordered.where("is_compaction").groupBy("session_id").agg(F.count("*").alias("compactions"), F.max(F.col("before") - F.col("context")).alias("largest_drop"))


@report("a30_subagents")
def subagents(f: Facts) -> DataFrame:
    return f.turns.where("is_agent").groupBy("session_id", "file_id").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), money())


@report("a32_agent_summary")
def agent_summary(f: Facts) -> DataFrame:
    return f.turns.where("is_agent and entry_agent_id <> ''").groupBy("session_id", F.col("entry_agent_id").alias("agent_id")).agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), money())


@report("a33_session_histograms")
def session_histograms(f: Facts) -> DataFrame:
    """(session_id, kind, value, turns): stop reasons, and service tiers, speeds, regions and branches that are not empty."""
    kinds = {"stop_reason": "stop_reason", "tier": "service_tier", "speed": "speed", "geo": "inference_geo", "branch": "git_branch"}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items())))
    return f.turns.select("session_id", pairs.alias("x")).select("session_id", "x.*").where("value is not null and (value <> '' or kind = 'stop_reason')").groupBy("session_id", "kind", "value").agg(F.count("*").alias("turns"))


@report("a34_session_totals")
def session_totals(f: Facts) -> DataFrame:
    writes = F.col("cw_5m") + F.col("cw_1h")
    return f.sessions.select("session_id", "minutes", "max_context", "compactions", share(F.col("cw_5m"), writes).alias("share_5m"), share(F.col("cw_1h"), writes).alias("share_1h"), "truncated", usd("cost").alias("cost_usd"))


@report("a51_turn_counters")
def turn_counters(f: Facts) -> DataFrame:
    return f.sessions.select("session_id", "turns", "agent_turns", (F.col("turns") - F.col("agent_turns")).alias("main_turns"))


def usage_by(f: Facts, name: str) -> DataFrame:
    return f.turns.where(~F.col("is_agent") & (F.col(name) != "")).groupBy("session_id", name).agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), money())


@report("a27_plugin_usage")
def plugin_usage(f: Facts) -> DataFrame:
    return usage_by(f, "plugin")


@report("a28_skill_usage")
def skill_usage(f: Facts) -> DataFrame:
    return usage_by(f, "skill")


@report("t05_latest_session")
def latest_session(f: Facts) -> DataFrame:
    return f.sessions.where("last_ts is not null").orderBy(F.desc("last_ts"), "session_id").limit(1).select("session_id", "turns")


@report("t06_session_order")
def session_order(f: Facts) -> DataFrame:
    """Sessions by the first turn of their main file, latest first, those without one last; a session's neighbours are what a list shows."""
    main = f.turns.where("not is_agent").groupBy("session_id").agg(F.min("ts").alias("main_ts"))
    return f.all_sessions.join(main, "session_id", "left").orderBy(F.desc_nulls_last("main_ts"), "session_id").select("session_id", F.date_format("main_ts", STAMP).alias("main_ts"))


def places_row(f: Facts | DataFrame, found: dict[str, int | None]) -> DataFrame:
    """One row of the values that select_places() found."""
    spark = (f.turns if isinstance(f, Facts) else f).sparkSession
    return spark.range(1).select(*(F.lit(v).cast("long").alias(name) for name, v in found.items()))


def distribution(counts: DataFrame, value: str) -> DataFrame:
    """One row of how often (n) each value stands: places n/2, n*90/100 and n*99/100 of the sorted values, ends, number, sum and mean."""
    found = select_places(counts, value, {"low": lambda n: 0, "median": lambda n: n // 2, "p90": lambda n: n * 90 // 100, "p99": lambda n: n * 99 // 100, "high": lambda n: n - 1}, "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.coalesce(F.sum(F.col("n") * F.col(value)), F.lit(0)).alias("total"))
    return places_row(counts, found).crossJoin(total).withColumn("mean", share(F.col("total"), F.col("sessions"), 1.0))  # one row each


@report("a46_session_sizes")
def session_sizes(f: Facts) -> DataFrame:
    """Distribution of turns a session."""
    return distribution(f.sessions.groupBy("turns").agg(F.count("*").alias("n")), "turns")


@report("p08_session_kpis")
def session_kpis(f: Facts) -> DataFrame:
    s = f.sessions.agg(F.count("*").alias("sessions"), F.sum("cost").alias("cost"), F.sum(F.expr("coalesce((unix_micros(last_ts) - unix_micros(first_ts)) div 1000000, 0)")).alias("secs"))
    return s.select("sessions", usd("cost").alias("cost_usd"), share(usd("cost"), F.col("sessions"), 1.0).alias("cost_per_session"), share(F.col("secs") / 60.0, F.col("sessions"), 1.0).alias("mean_minutes"))


@report("p17_session_bubbles")
def session_bubbles(f: Facts) -> DataFrame:
    s = f.sessions.where("turns > 0")
    top = s.agg(F.greatest(F.lit(1), F.max("output_tokens")).alias("top"))
    return s.crossJoin(top).select("session_id", "turns", usd("cost").alias("cost_usd"), (3 + 20.0 * F.col("output_tokens") / F.col("top")).alias("radius"), share(usd("cost"), F.col("turns"), 1.0).alias("cost_per_turn"))  # top is one row


@report("p18_context_series")
def context_series(f: Facts) -> DataFrame:
    return f.ordered.select("session_id", "turn_number", "context", share(F.col("cache_read"), F.col("context")).alias("cache_hit_rate"))


@report("p06_overview_kpis")
def overview_kpis(f: Facts) -> DataFrame:
    s = f.sessions.agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.sum("agent_turns").alias("agent"), F.sum("cost").alias("cost"), F.count_distinct("start_day").alias("start_days"), F.max("max_context").alias("peak_context"), F.sum(F.expr("coalesce((unix_micros(last_ts) - unix_micros(first_ts)) div 1000000, 0)")).alias("secs"))
    return s.select(share(F.col("agent"), F.col("turns")).alias("agent_percent"), (usd("cost") / F.greatest(F.lit(1), F.col("start_days"))).alias("daily_usd"), "peak_context", share(F.col("secs") / 60.0, F.col("sessions"), 1.0).alias("mean_minutes"))


@report("p12_date_range")
def date_range(f: Facts) -> DataFrame:
    return f.sessions.agg(F.min("start_day").alias("first_day"), F.max("start_day").alias("last_day"))


# Trend


def trend(f: Facts, days: int = 0, monthly: bool = False) -> DataFrame:
    """Turns by their day and sessions by their first turn's; days: only from today - days on (days + 1 dates), 0: from 2000 on. Labels without turns vanish."""
    since = F.lit("2000-01-01") if days == 0 else F.date_format(F.date_sub(F.lit(f.today).cast("date"), days), "yyyy-MM-dd")
    label = F.substring("day", 1, 7) if monthly else F.col("day")
    sums = ("turns", "input_tokens", "output_tokens", "cache_creation", "cache_read", "cost")
    h = f.hours.where("hour is not null").where(F.col("day") >= since)
    t = h.groupBy(label.alias("label")).agg(F.min("day").alias("date"), *(F.sum(c).alias(c) for c in sums), *(usd(F.sum(c)).alias(c) for c in ("cost_input", "cost_5m", "cost_1h", "cost_read", "cost_output")), F.count_if(F.col("first_ts") == F.col("session_first")).alias("sessions"))
    return t.withColumn("cost_usd", usd("cost")).withColumn("cost_per_turn", usd("cost") / F.col("turns")).drop("cost")


@report("a17_trend_daily")
def trend_daily(f: Facts) -> DataFrame:
    return trend(f)


@report("a17_trend_monthly")
def trend_monthly(f: Facts) -> DataFrame:
    return trend(f, monthly=True)


@report("f09_trend_last_week")
def trend_last_week(f: Facts) -> DataFrame:
    return trend(f, days=7)


def model_days(f: Facts, rows: int) -> DataFrame:
    return first_of(f.turns.groupBy("day", "model").agg(F.sum("output_tokens").alias("output_tokens")), ["day"], F.desc("output_tokens"), "model", rows=rows, rank="place")


@report("a18_trend_top_model")
def trend_top_model(f: Facts) -> DataFrame:
    return model_days(f, 1).drop("place")


@report("p11_top3_models")
def top3_models(f: Facts) -> DataFrame:
    return model_days(f, 3)


@report("p01_months_rounded")
def months_rounded(f: Facts) -> DataFrame:
    d = trend(f).groupBy(F.substring("label", 1, 7).alias("label")).agg(F.sum("sessions").alias("sessions"), F.sum("turns").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.round(F.col("cost_usd") * 1e9).cast("long")).alias("cost"))
    return d.select("label", "sessions", "turns", "output_tokens", F.round(usd("cost"), 2).alias("cost_usd"), F.round(share(usd("cost"), F.col("turns"), 1.0), 4).alias("cost_per_turn"))


@report("p02_extreme_days")
def extreme_days(f: Facts) -> DataFrame:
    """Days of the dearest tenth, of three days at least."""
    found = select_places(f.days, "cost", {"limit": lambda n: n * 9 // 10 if n >= 3 else -1})
    return f.days.where(F.col("cost") >= F.lit(found["limit"]).cast("long")).where("cost > 0").select("day", usd("cost").alias("cost_usd"))


@report("p03_trend_kpis")
def trend_kpis(f: Facts) -> DataFrame:
    d = f.days.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.count("*").alias("periods"))
    return d.select(usd("cost").alias("cost_usd"), "turns", share(usd("cost"), F.col("periods"), 1.0).alias("mean_usd"), share(usd("cost"), F.col("turns"), 1.0).alias("cost_per_turn"))


@report("p09_current_month")
def current_month(f: Facts) -> DataFrame:
    months = f.days.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.count("*").alias("active_days"), F.sum("turns").alias("turns"), F.sum("output_tokens").alias("output_tokens"), money())
    return months.orderBy(F.desc("month")).limit(1)


@report("p10_monthly_table")
def monthly_table(f: Facts) -> DataFrame:
    return trend(f, monthly=True).select("label", "sessions", "turns", "output_tokens", "cost_usd", "cost_per_turn")


# Heatmap


@report("a19_heatmap_days")
def heatmap_days(f: Facts) -> DataFrame:
    return f.calendar_days().select("day", "turns", "sessions", usd("cost").alias("cost_usd"))


@report("f10_heatmap_window")
def heatmap_window(f: Facts) -> DataFrame:
    return f.calendar_days(14).select("day", "turns", "sessions", usd("cost").alias("cost_usd"))


def thresholds(days: DataFrame) -> DataFrame:
    """p25, p50, p75 of the turns of active days: place floor(n p), 1 at least and never falling; (1, 2, 3) without any."""
    found = select_places(days.where("turns > 0"), "turns", {"p25": lambda n: n // 4, "p50": lambda n: n // 2, "p75": lambda n: n * 3 // 4})
    p25, p50, p75 = (found[k] or k_th for k, k_th in (("p25", 1), ("p50", 2), ("p75", 3)))
    return places_row(days, {"p25": max(p25, 1), "p50": max(p25, p50, 1), "p75": max(p25, p50, p75, 1)})


@report("h01_heatmap_thresholds")
def heatmap_thresholds(f: Facts) -> DataFrame:
    return thresholds(f.calendar_days())


def day_number(day: Column) -> Column:
    return F.datediff(day.cast("date"), F.lit("2000-01-01").cast("date"))


def streak_runs(days: Column) -> Column:
    """Array of (length, last) of the runs of days in a row of an array of distinct day numbers; the calendar bounds it."""
    kind = "array<struct<length:bigint,last:int>>"

    def add(runs: Column, day: Column) -> Column:
        tail = F.element_at(runs, -1)
        more = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["last"] == day - 1)
        return F.when(more, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct((tail["length"] + 1).alias("length"), day.alias("last"))))).otherwise(F.concat(runs, F.array(F.struct(F.lit(1).cast("long").alias("length"), day.alias("last"))))).cast(kind)

    return F.aggregate(F.sort_array(days), F.array().cast(kind), add)


def longest(runs: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(runs, lambda r: r["length"])), F.lit(0))


def streaks(active: DataFrame) -> DataFrame:
    """(length, last): runs of days in a row of distinct days (day: yyyy-MM-dd)."""
    n = day_number(F.col("day"))
    d = active.select("day", (n - F.row_number().over(Window.orderBy("day"))).alias("run"))
    return d.groupBy("run").agg(F.count("*").alias("length"), F.max("day").alias("last"))


@report("a20_heatmap_stats")
def heatmap_stats(f: Facts, days: int = 0) -> DataFrame:
    """Days, active days, the streak that ends today (0 if today has no turn), the longest streak, and the busiest day (the latest of several)."""
    d = f.calendar_days(days)
    active = F.col("turns") > 0
    stats = d.agg(F.count("*").alias("total_days"), F.count_if(active).alias("active_days"), F.max(F.when(active, F.struct("turns", "day"))).alias("b"), F.collect_set(F.when(active, day_number(F.col("day")))).alias("days"))
    runs = streak_runs(F.col("days"))
    today = F.datediff(F.lit(f.today).cast("date"), F.lit("2000-01-01").cast("date"))
    return stats.select("total_days", "active_days", F.coalesce(F.array_max(F.transform(F.filter(runs, lambda r: r["last"] == today), lambda r: r["length"])), F.lit(0)).alias("current_streak"), longest(runs).alias("longest_streak"), F.col("b.day").alias("busiest_day"), F.col("b.turns").alias("busiest_turns"))


@report("h05_heatmap_levels")
def heatmap_levels(f: Facts) -> DataFrame:
    t = F.col("turns")
    level = F.when(t == 0, 0).when(t < F.col("p25"), 1).when(t < F.col("p50"), 2).when(t < F.col("p75"), 3).otherwise(4)
    return f.calendar_days().crossJoin(heatmap_thresholds(f)).select("day", level.alias("level"), heat_glyph(level).alias("glyph"))  # thresholds are one row


@report("h06_calendar_grid")
def calendar_grid(f: Facts) -> DataFrame:
    """Weekday (Monday 0) and week of each day, weeks counted from the Monday on or before the first day; month: a label where it begins."""
    d = f.calendar_days().withColumn("date", F.col("day").cast("date"))
    first = d.agg(F.to_date(F.date_trunc("week", F.min("date"))).alias("monday"))
    return d.crossJoin(first).select("day", F.weekday("date").alias("weekday"), F.expr("cast(datediff(date, monday) div 7 as int)").alias("week"), F.when(F.dayofmonth("date") == 1, F.date_format("date", "MMM")).otherwise("").alias("month"))  # first is one row


@report("p04_quantile_levels")
def quantile_levels(f: Facts) -> DataFrame:
    """Levels 0 to 4 of active days by P25, 50, 75 and 95 of the cost's cents at place floor(p (n - 1)), forced to rise."""
    d = f.days.withColumn("cents", F.floor(F.col("cost") / 10_000_000).cast("long")).where("cents > 0")
    found = select_places(d, "cents", {f"q{p}": (lambda n, p=p: (n - 1) * p // 100) for p in (25, 50, 75, 95)})
    q25, q50, q75, q95 = (found[f"q{p}"] or 0 for p in (25, 50, 75, 95))
    q = places_row(f, {"l1": max(q25, 1), "l2": max(q50, q25 + 1), "l3": max(q75, q50 + 1), "l4": max(q95, q75 + 1)})
    level = F.when(F.col("cents") <= F.col("l1"), 1).when(F.col("cents") <= F.col("l2"), 2).when(F.col("cents") <= F.col("l3"), 3).otherwise(4)
    return d.crossJoin(q).select("day", "cents", level.alias("level"))  # q is one row


@report("t07_active_days")
def active_days(f: Facts) -> DataFrame:
    """The dashboard's payload: active days only, in order; a day with sessions alone has none of its turns."""
    both = f.days.join(f.starts, "day", "full").fillna(0, ["turns", "cost", "sessions"])
    return both.select("day", "turns", usd("cost").alias("cost_usd"), "sessions").orderBy("day")


# Wrapped


def of_year(f: Facts, year: int) -> Facts:
    """Only sessions whose first turn is of the year, with all of their turns."""
    ids = f.sessions.where(F.year("first_ts") == year).select("session_id")
    return Facts(f.turns.join(ids, "session_id", "left_semi"), f.all_sessions.join(ids, "session_id", "left_semi"), f.today)


YEAR = 2024


@report("a21_wrapped")
def wrapped(f: Facts, year: int = YEAR, prompts: DataFrame | None = None) -> DataFrame:
    """One row: volume, days, averages, peaks, archetype. Mean minutes only over sessions that last; peaks: the last of several.

    prompts: (session_id, user_entries), from a tree's metadata(); with them also user_prompts and autonomy_ratio, turns a prompt (0 without any).
    """
    if prompts is not None:
        years = f.hours.where("hour is not null").where(F.year("session_first") == year).select("session_id").distinct()
        asked = prompts.join(years, "session_id", "left_semi").agg(F.coalesce(F.sum("user_entries"), F.lit(0)).alias("user_prompts"))
        return wrapped(f, year).crossJoin(asked).withColumn("autonomy_ratio", share(F.col("turns"), F.col("user_prompts"), 1.0))  # one row each
    h = f.hours.where("hour is not null").where(F.year("session_first") == year)
    own = ("session_id", "project", "session_first", "session_last")
    cube = h.groupingSets([own, ["day"], ["hour"], ["dow"], []], *own, "day", "hour", "dow").agg(
        F.when(F.grouping("session_id") == 0, "session").when(F.grouping("day") == 0, "day").when(F.grouping("hour") == 0, "hour").when(F.grouping("dow") == 0, "dow").otherwise("all").alias("kind"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("turns", "agent_turns", "output_tokens", "context", "cost")),
    )
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    secs = F.expr("(unix_micros(session_last) - unix_micros(session_first)) div 1000000")
    s = cube.agg(
        F.count(of("session", F.lit(1))).alias("sessions"), *(F.coalesce(F.sum(of("all", F.col(c))), F.lit(0)).alias(c) for c in ("turns", "agent_turns", "output_tokens", "context", "cost")),
        F.count_distinct(of("session", F.coalesce(project_display_name(F.col("project")), F.lit("(unknown)")))).alias("projects"), F.sum(of("session", F.when(secs > 0, secs))).alias("secs"), F.count(of("session", F.when(secs > 0, 1))).alias("lasting"),
        F.count(of("day", F.lit(1))).alias("active_days"), F.coalesce(F.sum(of("hour", F.when(F.expr(NIGHT), F.col("turns")))), F.lit(0)).alias("night"), F.collect_set(of("day", day_number(F.col("day")))).alias("days"),
        F.max(of("hour", F.struct(F.col("turns").alias("n"), "hour"))).alias("h"), F.max(of("dow", F.struct(F.col("turns").alias("n"), "dow"))).alias("d"),
    ).withColumn("longest_streak", longest(streak_runs(F.col("days"))))
    today = F.lit(f.today).cast("date")
    all_days = F.when(F.year(today) == year, F.dayofyear(today)).when(F.year(today) > year, F.dayofyear(F.lit(f"{year}-12-31").cast("date"))).otherwise(0)
    minutes = share(F.coalesce("secs", F.lit(0)) / 60.0, F.col("lasting"), 1.0)
    kind = archetype(share(F.col("agent_turns"), F.col("turns"), 1.0), share(F.col("night"), F.col("turns"), 1.0), minutes, share(F.col("turns"), F.col("sessions"), 1.0), F.col("projects"))
    return s.select(
        F.lit(year).alias("year"), "sessions", "turns", "agent_turns", "output_tokens", F.col("context").alias("input_tokens"), usd("cost").alias("cost_usd"), "projects", "active_days", all_days.cast("long").alias("total_days"), F.greatest(F.lit(0), all_days - F.col("active_days")).cast("long").alias("ghost_days"), "longest_streak",
        minutes.alias("mean_minutes"), share(usd("cost"), F.col("sessions"), 1.0).alias("cost_per_session"), share(F.col("output_tokens"), F.col("context")).alias("output_ratio"), F.coalesce("h.hour", F.lit(0)).alias("peak_hour"),
        F.element_at(F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))), F.coalesce("d.dow", F.lit(0)) + 1).alias("peak_weekday"), kind.alias("archetype"),
    )


@report("a25_model_distribution")
def model_distribution(f: Facts) -> DataFrame:
    return of_year(f, YEAR).turns.groupBy("model").agg(F.count("*").alias("turns"))


@report("t03_wrapped_top_projects")
def wrapped_top_projects(f: Facts) -> DataFrame:
    return of_year(f, YEAR).sessions.groupBy("display").agg(F.sum("cost").alias("cost")).orderBy(F.desc("cost"), "display").limit(5).select("display", usd("cost").alias("cost_usd"))


@report("t03_wrapped_top_tools")
def wrapped_top_tools(f: Facts) -> DataFrame:
    return tool_uses(of_year(f, YEAR)).orderBy(F.desc("uses"), "tool").limit(5)


@report("t04_wrapped_extremes")
def wrapped_extremes(f: Facts) -> DataFrame:
    """The dearest and the longest session, the first of several; P14: the dearest one's share of the cost, the longest in hours."""
    s = of_year(f, YEAR).sessions
    dear, long = (s.orderBy(F.desc(c), "session_id").limit(1) for c in ("cost", "minutes"))
    total = s.agg(F.sum("cost").alias("total"))
    a = dear.crossJoin(total).select(F.lit("dearest").alias("kind"), "session_id", "display", usd("cost").alias("value"), (usd("cost") / F.greatest(usd("total"), F.lit(0.01)) * 100).alias("share_or_hours"))  # one row each
    return a.unionByName(long.select(F.lit("longest").alias("kind"), "session_id", "display", F.col("minutes").alias("value"), (F.col("minutes") / 60).alias("share_or_hours")))


@report("x25_archetypes")
def archetypes(f: Facts) -> DataFrame:
    """Of the sessions that began in each month: the archetype, its label and description, and the month's short name."""
    h = f.hours.where("hour is not null").withColumn("month", F.date_format("session_first", "yyyy-MM"))
    s = h.groupBy("month", "session_id", "session_first", "session_last", "project").agg(F.sum("turns").alias("turns"), F.sum("agent_turns").alias("agent"), F.sum(F.when(F.expr(NIGHT), F.col("turns")).otherwise(0)).alias("night"))
    secs = F.expr("(unix_micros(session_last) - unix_micros(session_first)) div 1000000")
    m = s.groupBy("month").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in ("turns", "agent", "night")), F.sum(F.when(secs > 0, secs)).alias("secs"), F.count(F.when(secs > 0, 1)).alias("lasting"), F.count_distinct(project_display_name(F.col("project"))).alias("projects"))
    kind = archetype(F.col("agent") / F.col("turns"), F.col("night") / F.col("turns"), share(F.coalesce("secs", F.lit(0)) / 60.0, F.col("lasting"), 1.0), F.col("turns") / F.col("sessions"), F.col("projects"))
    label, text = archetype_text(F.col("archetype"))
    return m.withColumn("archetype", kind).select("month", F.date_format(F.concat("month", F.lit("-01")).cast("date"), "MMM").alias("short"), "archetype", label.alias("label"), text.alias("description"))


# Names and figures as text


@report("p16_model_families")
def model_families(f: Facts) -> DataFrame:
    return f.turns.select(F.lower(F.split("short", "-")[0]).alias("family")).distinct()


@report("x02_model_names")
def model_names(f: Facts) -> DataFrame:
    return f.turns.select("model", "bare_model", "short").distinct()


@report("p13_chart_orders")
def chart_orders(f: Facts) -> DataFrame:
    """(chart, place, name): all models by turns, ten tools by uses, five projects by cost."""
    lists = {"models": (f.turns.groupBy("model").agg(F.count("*").alias("v")), "model", None), "tools": (tool_uses(f).withColumnRenamed("uses", "v"), "tool", 10), "projects": (f.turns.groupBy("display").agg(F.sum("cost").alias("v")), "display", 5)}
    out = None
    for chart, (df, name, rows) in lists.items():
        part = first_of(df.select(F.lit(chart).alias("chart"), F.col(name).alias("name"), "v"), ["chart"], F.desc("v"), "name", rows=rows or (1 << 31) - 1, rank="place").select("chart", "place", "name")
        out = part if out is None else out.unionByName(part)
    return out


@report("x03_figures_as_text")
def figures_as_text(f: Facts) -> DataFrame:
    s = f.sessions
    return s.select("session_id", format_number(F.col("context")).alias("context"), format_cost(F.col("cost")).alias("cost"), format_duration(F.col("minutes")).alias("duration"), truncate_bytes(F.col("display"), 12).alias("project"), compact_number(F.col("context")).alias("compact"), escape_html(F.col("display")).alias("html"))


@report("x16_price_age")
def age_of_prices(f: Facts) -> DataFrame:
    """For each day with turns, how old the prices were on it, in days (below 0: taken later), and whether that is stale."""
    days, stale = price_age(F.col("day").cast("date"))
    return f.days.select("day", days.alias("days"), stale.alias("stale"))


@report("s24_price_table")
def price_table(f: Facts) -> DataFrame:
    """Every built-in price with the turns that it prices."""
    table = f.turns.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(p[0]).alias("price_key"), *(F.lit(v).cast("long").alias(r) for r, v in zip(RATES, p[1:], strict=True))) for p in PRICES))).alias("p")).select("p.*")
    return table.join(f.turns.groupBy("price_key").agg(F.count("*").alias("turns")), "price_key", "left").fillna(0, ["turns"])


@report("t08_table_sort")
def table_sort(f: Facts) -> DataFrame:
    """Projects with their places in a table sorted by name (falling) and by cost (rising): one row a project is ranked."""
    p = projects(f).select("project", "display", "cost_usd")
    place = lambda key, direction: F.row_number().over(Window.orderBy(*sort_columns(p, key, direction, "project")))
    return p.select("project", place("display", "desc").alias("by_name"), place("cost_usd", "asc").alias("by_cost"))
