"""DuckDB SQL that says what the reports say, written on its own from their definitions over the same tables."""

from __future__ import annotations

from ..functions.scalars import ARCHETYPES

TODAY, NOW = "2024-01-28", "2024-12-31 00:00:00"
# Prices in nano-dollars a token (input, 5 minutes, 1 hour, read, output), and the model of unknown ones.
_VALUES = """('claude-opus-4-8', 5000, 6250, 10000, 500, 25000), ('claude-opus-4-7', 5000, 6250, 10000, 500, 25000), ('claude-opus-4-6', 5000, 6250, 10000, 500, 25000), ('claude-opus-4-5', 5000, 6250, 10000, 500, 25000),
  ('claude-opus-4-1', 15000, 18750, 30000, 1500, 75000), ('claude-opus-4', 15000, 18750, 30000, 1500, 75000), ('claude-sonnet-4-6', 3000, 3750, 6000, 300, 15000), ('claude-sonnet-4-5', 3000, 3750, 6000, 300, 15000),
  ('claude-sonnet-4', 3000, 3750, 6000, 300, 15000), ('claude-haiku-4-5', 1000, 1250, 2000, 100, 5000), ('claude-haiku-3-5', 800, 1000, 1600, 80, 4000), ('claude-3-haiku', 250, 300, 500, 30, 1250)"""
FALLBACK = "claude-opus-4-8"
BASE = f"""with raw as (
  select 's' || lpad(user_id::varchar, 4, '0') || '-' || strftime(ts, '%Y%m%d') as session_id, '-Users-dev-proj' || (user_id % 12) as project,
    case when event_id % 41 = 0 then '<synthetic>' else case event_type when 'purchase' then 'claude-opus-4-6' when 'signup' then 'claude-sonnet-4-5-20250929' when 'view' then 'claude-haiku-4-5' when 'click' then 'claude-opus-4-8[1m]' else 'claude-future-x-1' end end as model,
    ts, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as input_tokens, coalesce(cast(floor(value * 100) as bigint), 0) as output_tokens,
    event_id * 104729 % 5000 as cache_creation, event_id * 7919 % 50000 as cache_read, event_id % 3 <> 0 as has_ttl,
    event_id * 104729 % 5000 - (event_id * 104729 % 5000) // 4 as cw_5m, (event_id * 104729 % 5000) // 4 as cw_1h,
    event_id % 4 = 0 as is_agent, case when event_id % 4 = 0 then event_id % 7 else -1 end as file_id,
    case when event_id % 11 <> 0 then 'r' || (event_id // 50 * 50) end as request_id,
    case event_id % 4 when 0 then 'tool_use' when 1 then 'end_turn' when 2 then 'max_tokens' else 'stop_sequence' end as stop_reason,
    case event_id % 5 when 0 then ['Bash'] when 1 then ['Edit', 'Bash'] when 2 then ['Read'] else [] end as tool_names,
    case when event_id % 6 = 0 then '' when event_id % 2 = 0 then 'main' else 'dev' end as git_branch,
    case event_id % 9 when 0 then 'toolkit' when 1 then '' end as plugin, case event_id % 10 when 0 then 'review' when 3 then '' end as skill,
    case when event_id % 4 = 0 then 'a' || (event_id % 7) end as entry_agent_id, case event_id % 4 when 1 then 'priority' when 2 then 'standard' end as service_tier,
    case when event_id % 3 = 1 then 'fast' else '' end as speed, case when event_id % 5 = 2 then 'us' end as inference_geo, event_id % 37 = 0 as is_sidechain, event_id as line_pos
  from events),
all_sessions as (select session_id, min(project) as project from raw group by 1),
valid as (select * from raw where not (is_sidechain and not is_agent) and model <> '<synthetic>' and input_tokens + output_tokens + cache_creation + cache_read > 0 and ts <= timestamp '{NOW}'),
numbered as (select *, max(line_pos) over w as last_pos, min(line_pos) over w as first_pos from valid window w as (partition by session_id, file_id, coalesce(request_id, 'line' || line_pos))),
once as (select * exclude (line_pos, last_pos, first_pos), first_pos as line_pos from numbered where line_pos = last_pos),
kept as (select * from once a where not is_agent or request_id is null or (session_id, request_id) not in (select (session_id, request_id) from once where not is_agent and request_id is not null)),
prices(price_key, r_input, r_5m, r_1h, r_read, r_output) as (values {_VALUES}),
models as (select distinct model, regexp_replace(model, '\\[.*\\]$', '') as bare_model from raw),
resolved as (select model, bare_model, coalesce((select max_by(price_key, length(price_key)) from prices where starts_with(bare_model, price_key)), '{FALLBACK}') as price_key,
  case when bare_model in (select price_key from prices) then 'exact' when exists (select 1 from prices where starts_with(bare_model, price_key)) then 'prefix' else 'fallback' end as source from models),
turns as (select k.*, r.bare_model, r.source, p.*, input_tokens + cache_creation + cache_read as context, strftime(ts, '%Y-%m-%d') as day, hour(ts)::int as hour, (isodow(ts) - 1)::int as dow,
    input_tokens * r_input as cost_input, (case when has_ttl then cw_5m else cache_creation end) * r_5m as cost_5m, (case when has_ttl then cw_1h else 0 end) * r_1h as cost_1h, cache_read * r_read as cost_read, output_tokens * r_output as cost_output,
    input_tokens * r_input + (case when has_ttl then cw_5m else cache_creation end) * r_5m + (case when has_ttl then cw_1h else 0 end) * r_1h + cache_read * r_read + output_tokens * r_output as cost,
    '~' || replace(substr(project, 11), '-', '/') as display, regexp_replace(replace(model, 'claude-', ''), '-[0-9]{{8}}$', '') as short
  from kept k join resolved r using (model) join prices p using (price_key)),
ordered as (select *, row_number() over w as turn_number, lag(context) over w as before from turns window w as (partition by session_id order by ts, file_id, line_pos)),
marked as (select *, coalesce(before > 0 and context * 10 < before * 9, false) as is_compaction from ordered),
stats as (select session_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as turns, count(*) filter (is_agent) as agent_turns, sum(output_tokens)::bigint as output_tokens, sum(context)::bigint as context, sum(cache_read)::bigint as cache_read, sum(cost)::bigint as cost,
    coalesce(sum(cw_5m) filter (has_ttl), 0)::bigint as cw_5m, coalesce(sum(cw_1h) filter (has_ttl), 0)::bigint as cw_1h, max(context) as max_context, count(*) filter (is_compaction) as compactions, count(*) filter (stop_reason = 'tool_use') as tool_use_stops, count(*) filter (stop_reason = 'max_tokens') as truncated from marked group by 1),
sess as (select s.session_id, s.project, '~' || replace(substr(s.project, 11), '-', '/') as display, first_ts, last_ts, strftime(first_ts, '%Y-%m-%d') as start_day, coalesce(date_sub('second', first_ts, last_ts), 0) as secs, coalesce(date_sub('second', first_ts, last_ts), 0) / 60 as minutes,
    coalesce(turns, 0) as turns, coalesce(agent_turns, 0) as agent_turns, coalesce(output_tokens, 0) as output_tokens, coalesce(context, 0) as context, coalesce(cache_read, 0) as cache_read, coalesce(cost, 0) as cost, coalesce(cw_5m, 0) as cw_5m, coalesce(cw_1h, 0) as cw_1h, coalesce(max_context, 0) as max_context, coalesce(compactions, 0) as compactions, coalesce(tool_use_stops, 0) as tool_use_stops, coalesce(truncated, 0) as truncated
  from all_sessions s left join stats using (session_id)),
days as (select day, count(*) as turns, sum(output_tokens)::bigint as output_tokens, sum(cost)::bigint as cost from turns group by 1),
starts as (select start_day as day, count(*) as sessions from sess where start_day is not null group by 1),
cal as (select strftime(d, '%Y-%m-%d') as day, d::date as date, coalesce(turns, 0) as turns, coalesce(cost, 0) as cost, coalesce(sessions, 0) as sessions
  from (select unnest(generate_series((select min(start_day)::date from sess), date '{TODAY}', interval 1 day)) as d) g left join days on days.day = strftime(d, '%Y-%m-%d') left join starts on starts.day = strftime(d, '%Y-%m-%d')),
y as (select * from sess where year(first_ts) = 2024), yt as (select * from turns where session_id in (select session_id from y)),
uses as (select session_id, unnest(tool_names) as tool from turns)
"""

TOK = "sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_creation)::bigint as cache_creation, sum(cache_read)::bigint as cache_read"
USD = "sum(cost)::bigint / 1e9 as cost_usd"


def _pct(part: str, whole: str, of: str = "1e2") -> str:
    return f"case when {whole} = 0 then 0.0::double else ({part}) * {of} / ({whole}) end"


def _nth(table: str, value: str, place: str) -> str:
    """The value at a place (from 0) of a table's sorted rows; n is their number."""
    return f"(select list_sort(list({value}))[({place.replace('n', 'count(*)')})::bigint + 1] from {table})"


def _trend(since: str, cut: int) -> str:
    return f"""select label, min(day) as date, count(*) as turns, {TOK}, sum(cost_input)::bigint / 1e9 as cost_input, sum(cost_5m)::bigint / 1e9 as cost_5m, sum(cost_1h)::bigint / 1e9 as cost_1h, sum(cost_read)::bigint / 1e9 as cost_read, sum(cost_output)::bigint / 1e9 as cost_output,
      coalesce(any_value(n), 0) as sessions, {USD}, sum(cost)::bigint / 1e9 / count(*) as cost_per_turn
    from (select *, substr(day, 1, {cut}) as label from turns where day >= '{since}') t left join (select substr(day, 1, {cut}) as label, sum(sessions)::bigint as n from starts where day >= '{since}' group by 1) s using (label) group by label"""


def _ranked(select: str, keys: str, order: str, rows: int, columns: str) -> str:
    return f"select {columns} from (select *, row_number() over (partition by {keys} order by {order}) as rn from ({select})) where rn <= {rows}"


_PROJECTS = f"""select project, '~' || replace(substr(project, 11), '-', '/') as display, any_value(s.sessions) as sessions, count(t.session_id) as turns, count(t.session_id) filter (is_agent) as agent_turns, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens, coalesce(sum(cache_creation), 0)::bigint as cache_creation, coalesce(sum(cache_read), 0)::bigint as cache_read, coalesce(sum(cost), 0)::bigint / 1e9 as cost_usd,
  coalesce(any_value(m.model), '') as primary_model
from (select project, count(*) as sessions from all_sessions group by 1) s left join turns t using (project) left join ({_ranked("select project, model, count(*) as turns from turns group by 1, 2", "project", "turns desc, model", 1, "project, model")}) m using (project) group by project"""
_FIRST_MODEL = _ranked("select session_id, model, count(*) as turns from turns group by 1, 2", "session_id", "turns desc, model", 1, "session_id, model, turns")
_TOP_TOOLS = _ranked("select session_id, tool, count(*) as uses from uses group by 1, 2", "session_id", "uses desc, tool", 5, "session_id, tool, uses, rn::int as place")
_RUNS = "select count(*) as length, max(day) as last from (select day, day::date - (row_number() over (order by day))::int as run from {0}) group by run"
_DURATION = "case when minutes < 1 then round_even(minutes * 60, 0)::bigint || 's' when minutes < 60 then round_even(minutes, 0)::bigint || 'm' else floor(minutes / 60)::bigint || 'h' || round(minutes % 60)::bigint || 'm' end"
_COST = "'$' || format('{:,}', ((cost + 5000000) // 10000000) // 100) || '.' || lpad((((cost + 5000000) // 10000000) % 100)::varchar, 2, '0')"
_ARCHETYPE = "case when agent > 0.5 then 'Delegator' when night > 0.5 then 'NightOwl' when minutes > 120 then 'Marathoner' when agent > 0.4 and minutes > 60 then 'Architect' when minutes < 30 and per_session > 10 then 'Sprinter' when projects > 10 then 'Explorer' else 'Architect' end"
_P25, _P50, _P75 = (_nth("(select * from cal where turns > 0)", "turns", f"floor(n * {p})") for p in (0.25, 0.5, 0.75))
_Q = [_nth("(select cost // 10000000 as cents from days where cost >= 10000000)", "cents", f"floor((n - 1) * {p} / 100)") for p in (25, 50, 75, 95)]

SQL = {
    "a03_overview_by_model": f"select model, count(*) as turns, {TOK}, {USD} from turns group by 1",
    "a04_overview_totals": f"select (select count(*) from all_sessions) as sessions, count(*) as turns, count(*) filter (is_agent) as agent_turns, sum(output_tokens)::bigint as output_tokens, sum(context)::bigint as context, {USD} from turns",
    "a05_cost_by_category": "select sum(cost_input)::bigint / 1e9 as cost_input, sum(cost_5m)::bigint / 1e9 as cost_5m, sum(cost_1h)::bigint / 1e9 as cost_1h, sum(cost_read)::bigint / 1e9 as cost_read, sum(cost_output)::bigint / 1e9 as cost_output from turns",
    "a06_hours": "select h::int as hour, (select count(*) from turns where hour = h) as turns from (select unnest(range(24)) as h)",
    "a07_weekday_hours": "select d::int as dow, h::int as hour, (select count(*) from turns where hour = h and dow = d) as turns from (select unnest(range(24)) as h), (select unnest(range(7)) as d)",
    "a08_tools": "select tool, count(*) as uses from uses group by 1",
    "a09_cache_hit_rate": f"select {_pct('sum(cache_read)::bigint', 'sum(context)::bigint')} as cache_hit_rate from turns",
    "a10_cache_savings": "select model, sum(cache_read * (r_input - r_read))::bigint / 1e9 as saved_usd from turns group by 1 having saved_usd > 0.01",
    "a10_cache_savings_total": "select sum(cache_read * (r_input - r_read))::bigint / 1e9 as saved_usd, sum(cache_read * r_input)::bigint / 1e9 as without_usd, sum(cache_read * r_read)::bigint / 1e9 as with_usd, sum(cache_read * (r_input - r_read))::bigint * 1e2 / sum(cache_read * r_input)::bigint as saved_percent from turns",
    "a11_subscription_value": "select 200.0::double as monthly_usd, sum(cost)::bigint / 1e9 as api_usd, sum(cost)::bigint / 1e9 / 200 as multiplier from turns",
    "a12_efficiency": "select sum(output_tokens)::bigint * 1e2 / sum(context)::bigint as output_ratio, sum(cost)::bigint / 1e9 / count(*) as cost_per_turn, (sum(output_tokens) // count(*))::bigint as tokens_per_turn from turns",
    "a13_pricing_warnings": f"select bare_model as requested, min(price_key) as used, count(*) as turns, {USD} from turns where source = 'fallback' group by 1",
    "a14_session_summaries": f"""select session_id, substr(session_id, 1, 8) as id8, display, minutes, coalesce(m.model, '') as model, s.turns, agent_turns, output_tokens, context, max_context, {_pct("cache_read", "context")} as cache_hit_rate, {_pct("cw_5m", "cw_5m + cw_1h")} as share_5m, compactions, cost / 1e9 as cost_usd, tool_use_stops, coalesce(top_tools, '') as top_tools, {_pct("output_tokens", "context")} as output_ratio, {_pct("cost / 1e9", "s.turns", "1")} as cost_per_turn
      from sess s left join ({_FIRST_MODEL}) m using (session_id) left join (select session_id, string_agg(tool || ':' || uses, ',' order by place) as top_tools from ({_TOP_TOOLS}) group by 1) using (session_id)""",
    "a16_session_primary_model": _FIRST_MODEL,
    "a16_project_primary_model": _ranked("select project, model, count(*) as turns from turns group by 1, 2", "project", "turns desc, model", 1, "project, model, turns"),
    "t02_session_top_tools": _TOP_TOOLS,
    "a44_overview_insights": f"select greatest(1, date_sub('day', min(first_ts), max(last_ts))) as days, sum(cost)::bigint / 1e9 / greatest(1, date_sub('day', min(first_ts), max(last_ts))) as daily_usd, sum(compactions)::bigint as compactions, count(*) filter (compactions > 0) as compacted_sessions, max(max_context) as peak_context, sum(secs)::bigint / 60 / count(*) filter (secs > 0) as mean_minutes from sess",
    "a44_top_sessions": f"select substr(session_id, 1, 8) as id8, display as project, turns, {_DURATION} as duration, {_COST} as cost from sess order by sess.cost desc, session_id limit 3",
    "a15_projects": _PROJECTS,
    "t01_top_projects": _PROJECTS + " order by cost_usd desc, project limit 5",
    "f06_projects_by_name": f"select * from ({_PROJECTS}) where project like '%proj1%'",
    "p19_project_sessions": f"select display, session_id, turns, cost / 1e9 as cost_usd, row_number() over (partition by display order by cost desc, session_id) as place, {_pct('(sum(cache_read) over (partition by display))::bigint', '(sum(context) over (partition by display))::bigint')} as project_cache_rate from sess where turns > 0",
    "f07_sessions_by_prefix": "select session_id, turns from sess where session_id like 's0001-%'",
    "f12_session_search": f"select session_id, display, model from sess join ({_FIRST_MODEL}) m using (session_id) where (session_id ilike '%proj3%' or display ilike '%proj3%') and replace(model, 'claude-', '') like 'opus-%'",
    "w06_turn_detail": f"select session_id, turn_number, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, model, input_tokens, output_tokens, case when has_ttl then cw_5m else 0 end as cache_write_5m, case when has_ttl then cw_1h else 0 end as cache_write_1h, cache_read, context, {_pct('cache_read', 'context')} as cache_hit_rate, cost / 1e9 as cost_usd, cost_input / 1e9 as cost_input, cost_5m / 1e9 as cost_5m, cost_1h / 1e9 as cost_1h, cost_read / 1e9 as cost_read, cost_output / 1e9 as cost_output, stop_reason, is_agent, is_compaction, coalesce(context - before, 0) as context_delta, array_to_string(tool_names, ',') as tools from marked",
    "w01_compactions": "select session_id, count(*) as compactions, max(before - context) as largest_drop from marked where is_compaction group by 1",
    "a30_subagents": f"select session_id, file_id, count(*) as turns, sum(output_tokens)::bigint as output_tokens, {USD} from turns where is_agent group by 1, 2",
    "a32_agent_summary": f"select session_id, entry_agent_id as agent_id, count(*) as turns, sum(output_tokens)::bigint as output_tokens, {USD} from turns where is_agent group by 1, 2",
    "a33_session_histograms": " union all ".join(f"select session_id, '{k}' as kind, {c} as value, count(*) as turns from turns where {c} is not null and {c} <> '' group by 1, 3" for k, c in (("stop_reason", "stop_reason"), ("tier", "service_tier"), ("speed", "speed"), ("geo", "inference_geo"), ("branch", "git_branch"))),
    "a34_session_totals": f"select session_id, minutes, max_context, compactions, {_pct('cw_5m', 'cw_5m + cw_1h')} as share_5m, {_pct('cw_1h', 'cw_5m + cw_1h')} as share_1h, truncated, cost / 1e9 as cost_usd from sess",
    "a51_turn_counters": "select session_id, turns, agent_turns, turns - agent_turns as main_turns from sess",
    "a27_plugin_usage": f"select session_id, plugin, count(*) as turns, sum(output_tokens)::bigint as output_tokens, {USD} from turns where not is_agent and plugin = 'toolkit' group by 1, 2",
    "a28_skill_usage": f"select session_id, skill, count(*) as turns, sum(output_tokens)::bigint as output_tokens, {USD} from turns where not is_agent and skill = 'review' group by 1, 2",
    "t05_latest_session": "select session_id, turns from sess where last_ts = (select max(last_ts) from sess) order by 1 limit 1",
    "t06_session_order": "select session_id, strftime(main_ts, '%Y-%m-%d %H:%M:%S.%f') as main_ts from (select session_id, min(ts) filter (not is_agent) as main_ts from all_sessions left join turns using (session_id) group by 1) order by main_ts desc nulls last, session_id",
    "a46_session_sizes": f"select {_nth('sess', 'turns', '0')} as low, {_nth('sess', 'turns', 'n // 2')} as median, {_nth('sess', 'turns', 'n * 90 // 100')} as p90, {_nth('sess', 'turns', 'n * 99 // 100')} as p99, max(turns) as high, count(*) as sessions, sum(turns)::bigint as total, sum(turns)::bigint / count(*) as mean from sess",
    "p08_session_kpis": f"select count(*) as sessions, {USD}, sum(cost)::bigint / 1e9 / count(*) as cost_per_session, sum(secs)::bigint / 60 / count(*) as mean_minutes from sess",
    "p17_session_bubbles": "select session_id, turns, cost / 1e9 as cost_usd, 3 + 20.0::double * output_tokens / (select max(output_tokens) from sess) as radius, cost / 1e9 / turns as cost_per_turn from sess where turns > 0",
    "p18_context_series": f"select session_id, turn_number, context, {_pct('cache_read', 'context')} as cache_hit_rate from marked",
    "p06_overview_kpis": "select sum(agent_turns)::bigint * 1e2 / sum(turns)::bigint as agent_percent, sum(cost)::bigint / 1e9 / count(distinct start_day) as daily_usd, max(max_context) as peak_context, sum(secs)::bigint / 60 / count(*) as mean_minutes from sess",
    "p12_date_range": "select min(start_day) as first_day, max(start_day) as last_day from sess",
    "a17_trend_daily": _trend("2000-01-01", 10),
    "a17_trend_monthly": _trend("2000-01-01", 7),
    "f09_trend_last_week": _trend("2024-01-21", 10),
    "a18_trend_top_model": _ranked("select day, model, sum(output_tokens)::bigint as output_tokens from turns group by 1, 2", "day", "output_tokens desc, model", 1, "day, model, output_tokens"),
    "p11_top3_models": _ranked("select day, model, sum(output_tokens)::bigint as output_tokens from turns group by 1, 2", "day", "output_tokens desc, model", 3, "day, model, output_tokens, rn::int as place"),
    "p01_months_rounded": "select label, (select sum(sessions)::bigint from starts where substr(day, 1, 7) = label) as sessions, turns, output_tokens, round(cost / 1e9, 2) as cost_usd, round(cost / 1e9 / turns, 4) as cost_per_turn from (select substr(day, 1, 7) as label, sum(turns)::bigint as turns, sum(output_tokens)::bigint as output_tokens, sum(cost)::bigint as cost from days group by 1)",
    "p02_extreme_days": f"select day, cost / 1e9 as cost_usd from days where (select count(*) from days) >= 3 and cost > 0 and cost >= {_nth('days', 'cost', 'floor(n * 0.9)')}",
    "p03_trend_kpis": "select sum(cost)::bigint / 1e9 as cost_usd, sum(turns)::bigint as turns, sum(cost)::bigint / 1e9 / count(*) as mean_usd, sum(cost)::bigint / 1e9 / sum(turns)::bigint as cost_per_turn from days",
    "p09_current_month": f"select substr(day, 1, 7) as month, count(*) as active_days, sum(turns)::bigint as turns, sum(output_tokens)::bigint as output_tokens, {USD} from days where substr(day, 1, 7) = (select max(substr(day, 1, 7)) from days) group by 1",
    "p10_monthly_table": f"select label, sessions, turns, output_tokens, cost_usd, cost_per_turn from ({_trend('2000-01-01', 7)})",
    "a19_heatmap_days": "select day, turns, sessions, cost / 1e9 as cost_usd from cal",
    "f10_heatmap_window": "select day, turns, sessions, cost / 1e9 as cost_usd from cal where day >= '2024-01-15'",
    "h01_heatmap_thresholds": f"select greatest({_P25}, 1) as p25, greatest({_P25}, {_P50}, 1) as p50, greatest({_P25}, {_P50}, {_P75}, 1) as p75",
    "a20_heatmap_stats": f"select count(*) as total_days, count(*) filter (turns > 0) as active_days, coalesce((select max(length) from ({_RUNS.format('cal where turns > 0')}) where last = '{TODAY}'), 0) as current_streak, (select max(length) from ({_RUNS.format('cal where turns > 0')})) as longest_streak, (select day from cal where turns = (select max(turns) from cal) order by day desc limit 1) as busiest_day, max(turns) as busiest_turns from cal",
    "h05_heatmap_levels": f"select day, level, ['·', '░', '▒', '▓', '█'][level + 1] as glyph from (select day, case when turns = 0 then 0 when turns < greatest({_P25}, 1) then 1 when turns < greatest({_P25}, {_P50}, 1) then 2 when turns < greatest({_P25}, {_P50}, {_P75}, 1) then 3 else 4 end as level from cal)",
    "h06_calendar_grid": "select day, (isodow(date) - 1)::int as weekday, ((date - (select min(date) - (isodow(min(date)) - 1)::int from cal)) // 7)::int as week, case when dayofmonth(date) = 1 then strftime(date, '%b') else '' end as month from cal",
    "p04_quantile_levels": f"select day, cents, case when cents <= greatest({_Q[0]}, 1) then 1 when cents <= greatest({_Q[1]}, {_Q[0]} + 1) then 2 when cents <= greatest({_Q[2]}, {_Q[1]} + 1) then 3 else 4 end as level from (select day, cost // 10000000 as cents from days where cost >= 10000000)",
    "t07_active_days": "select coalesce(d.day, s.day) as day, coalesce(turns, 0) as turns, coalesce(cost, 0) / 1e9 as cost_usd, coalesce(sessions, 0) as sessions from days d full join starts s on d.day = s.day",
    "a21_wrapped": f"""select 2024 as year, sessions, turns, agent_turns, output_tokens, input_tokens, cost / 1e9 as cost_usd, projects, active_days, total_days, greatest(0, total_days - active_days) as ghost_days, longest_streak, minutes as mean_minutes, cost / 1e9 / sessions as cost_per_session, output_tokens * 1e2 / input_tokens as output_ratio, peak_hour, peak_weekday, {_ARCHETYPE} as archetype
      from (select *, agent_turns / turns as agent, night_turns / turns as night, turns / sessions as per_session from (select count(*) as sessions, sum(turns)::bigint as turns, sum(agent_turns)::bigint as agent_turns, sum(output_tokens)::bigint as output_tokens, sum(context)::bigint as input_tokens, sum(cost)::bigint as cost, count(distinct display) as projects, sum(secs)::bigint / 60 / count(*) filter (secs > 0) as minutes from y),
        (select count(distinct day) as active_days, dayofyear(date '{TODAY}') as total_days, count(*) filter (hour in (22, 23, 0, 1, 2, 3, 4, 5)) as night_turns from yt), (select max(length) as longest_streak from ({_RUNS.format("(select distinct day from yt)")})),
        (select hour as peak_hour from yt group by 1 order by count(*) desc, hour desc limit 1), (select dayname(any_value(ts)) as peak_weekday from yt group by dow order by count(*) desc, dow desc limit 1))""",
    "a25_model_distribution": "select model, count(*) as turns from yt group by 1",
    "t03_wrapped_top_projects": f"select display, {USD} from y group by 1 order by sum(cost) desc, display limit 5",
    "t03_wrapped_top_tools": "select tool, count(*) as uses from uses where session_id in (select session_id from y) group by 1 order by 2 desc, 1 limit 5",
    "t04_wrapped_extremes": "(select 'dearest' as kind, session_id, display, cost / 1e9 as value, cost / 1e9 / greatest((select sum(cost)::bigint from y) / 1e9, 0.01) * 100 as share_or_hours from y order by cost desc, session_id limit 1) union all (select 'longest', session_id, display, minutes, minutes / 60 from y order by minutes desc, session_id limit 1)",
    "x25_archetypes": f"""select month, strftime((month || '-01')::date, '%b') as short, archetype, label, description from (select *, {_ARCHETYPE} as archetype from (select month, sum(agent_turns) / sum(turns) as agent, sum(night) / sum(turns) as night, coalesce(sum(secs) filter (secs > 0) / 60 / nullif(count(*) filter (secs > 0), 0), 0) as minutes, sum(turns) / count(*) as per_session, count(distinct display) as projects
      from (select strftime(first_ts, '%Y-%m') as month, s.*, (select count(*) from turns t where t.session_id = s.session_id and hour in (22, 23, 0, 1, 2, 3, 4, 5)) as night from sess s where turns > 0) group by month)) join (values """
    + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in ARCHETYPES.items())
    + ") n(archetype, label, description) using (archetype)",
    "p16_model_families": "select distinct split_part(lower(short), '-', 1) as family from turns",
    "x02_model_names": "select distinct model, bare_model, short from turns",
    "p13_chart_orders": " union all ".join(
        f"select '{chart}' as chart, (row_number() over (order by v desc, name))::int as place, name from ({sql}) qualify place <= {n}" for chart, sql, n in (("models", "select model as name, count(*) as v from turns group by 1", 1000000), ("tools", "select tool as name, count(*) as v from uses group by 1", 10), ("projects", "select display as name, sum(cost) as v from turns group by 1", 5))
    ),
    "x03_figures_as_text": f"select session_id, format('{{:,}}', context) as context, {_COST} as cost, {_DURATION} as duration, display as project, case when sess.context >= 1000000 then format('{{:.2f}}M', sess.context / 1e6) when sess.context >= 10000 then format('{{:.1f}}K', sess.context / 1e3) else format('{{:,}}', sess.context) end as compact, display as html from sess",
    "x16_price_age": "select day, (day::date - date '2026-03-21')::int as days, day::date - date '2026-03-21' > 90 as stale from days",
    "s24_price_table": "select price_key, r_input, r_5m, r_1h, r_read, r_output, coalesce(turns, 0) as turns from prices left join (select price_key, count(*) as turns from turns group by 1) using (price_key)",
    "t08_table_sort": f"select project, (row_number() over (order by display desc, project))::int as by_name, (row_number() over (order by cost_usd, project))::int as by_cost from ({_PROJECTS})",
    "j01_price_resolution": "select model, price_key, source, r_input, r_5m, r_1h, r_read, r_output from resolved join prices using (price_key)",
    "j03_dedup_counts": "select project, count(*) as records, (select count(*) from once o where o.project = raw.project) as requests, (select count(*) from kept k where k.project = raw.project) as turns from raw group by 1",
    "f01_skip_reasons": "select case when is_sidechain and not is_agent then 'sidechain' when model = '<synthetic>' then 'synthetic' when input_tokens + output_tokens + cache_creation + cache_read = 0 then 'invalid' else 'turn' end as reason, count(*) as records from raw group by 1",
    "u03_shared_request_ids": "select distinct session_id, request_id from once where is_agent and request_id is not null and (session_id, request_id) in (select (session_id, request_id) from once where not is_agent)",
}
SQL["k08_dashboard_sessions"] = f"select * exclude (id8, cache_hit_rate), case when context > 0 then cache_hit_rate end as cache_hit_rate from ({SQL['a14_session_summaries']})"
SQL = {name: BASE + sql for name, sql in SQL.items()}

_LONGEST = "select conv_id, max(length) as longest from (select conv_id, count(*) as length from (select conv_id, turn - row_number() over (partition by conv_id order by turn) as run from (select distinct conv_id, turn from conversations)) group by conv_id, run) group by 1"
# Over conversations: an entry is a row, its node the turn's number, its parent the number before.
SQL |= {
    "j13_last_user_text": "select conv_id, turn, role, case when role = 'assistant' then (select arg_max(text, turn) from conversations u where u.conv_id = c.conv_id and u.turn < c.turn and u.role = 'user' and u.text <> '') end as user_text from conversations c",
    "a34_autonomy": "select conv_id, count(*) as entries, count(*) filter (role = 'assistant') as turns, count(*) filter (role = 'user') as prompts, case when count(*) filter (role = 'user') = 0 then 0 else count(*) filter (role = 'assistant') / count(*) filter (role = 'user') end as autonomy from conversations group by 1",
    "a47_entry_types": "select role as entry_type, count(*) as entries, count(*) * 1e2 / (select count(*) from conversations) as percent from conversations group by 1",
    "a45_graph_stats": "select conv_id, count(*) as nodes, count(*) filter (turn = 0) as roots, count(*) filter (turn > 0 and not exists (select 1 from conversations p where p.conv_id = n.conv_id and p.turn = n.turn - 1)) as orphans from (select distinct conv_id, turn from conversations) n group by 1",
    "g01_longest_chain": "select conv_id, max(length) as longest from (select conv_id, count(*) as length from (select conv_id, turn - row_number() over (partition by conv_id order by turn) as run from (select distinct conv_id, turn from conversations)) group by conv_id, run) group by 1",
    "a46_chain_buckets": f"select bucket, (select count(*) from ({_LONGEST}) where longest >= low and (high is null or longest <= high)) as n from (values ('0..1', 0::bigint, 1::bigint), ('2..10', 2, 10), ('11..50', 11, 50), ('51..200', 51, 200), ('201..1000', 201, 1000), ('>1000', 1001, null)) b(bucket, low, high)",
    "a46_root_histogram": "select roots, count(*) as sessions from (select conv_id, count(distinct turn) filter (turn = 0) as roots from conversations group by 1) group by 1",
    "a46_graph_sizes": " union all ".join(
        f"select '{kind}' as kind, {_nth(f'({t})', kind, '0')} as low, {_nth(f'({t})', kind, 'n // 2')} as median, {_nth(f'({t})', kind, 'n * 90 // 100')} as p90, {_nth(f'({t})', kind, 'n * 99 // 100')} as p99, max({kind}) as high, count(*) as sessions, sum({kind})::bigint as total, sum({kind})::bigint / count(*) as mean from ({t})"
        for kind, t in (("nodes", "select count(distinct turn) as nodes from conversations group by conv_id"), ("roots", "select count(distinct turn) filter (turn = 0) as roots from conversations group by conv_id"), ("longest", _LONGEST))
    ),
    "g03_response_groups": "select conv_id, first_user as grp, count(*) as entries, min(turn) as first_turn from (select conv_id, turn, role, (select count(*) from conversations u where u.conv_id = c.conv_id and u.turn < c.turn and u.role <> 'assistant') as first_user from conversations c) where role = 'assistant' group by 1, 2",
}
