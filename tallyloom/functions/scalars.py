"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_display_name(project: Column) -> Column:
    """-Users-<user>-a-b becomes ~/a/b; anything else stays."""
    tail = F.regexp_extract(project, "^-Users-[^-]*(-.*)$", 1)
    return F.when(tail != "", F.concat(F.lit("~"), F.translate(tail, "-", "/"))).otherwise(project)


def strip_bracket(model: Column) -> Column:
    """name[suffix] becomes name; a bracket that is not closed at the end stays."""
    return F.when((F.instr(model, "[") > 0) & F.endswith(model, F.lit("]")), F.substring_index(model, "[", 1)).otherwise(model)


def short_model(model: Column) -> Column:
    """Without its vendor prefix and, if more than nine bytes are left, without a date of eight digits at the end."""
    rest = F.regexp_replace(model, "^claude-", "")
    return F.when(F.octet_length(rest) > 9, F.regexp_replace(rest, "-[0-9]{8}$", "")).otherwise(rest)


def format_duration(minutes: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours and minutes; parts are rounded."""
    whole = F.bround(minutes).cast("long")
    return (
        F.when(minutes < 1, F.concat(F.bround(minutes * 60).cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(whole.cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.round(minutes % 60).cast("long").cast("string"), F.lit("m")))
    )


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_cost(nano: Column) -> Column:
    """Dollars from nano-dollars, to the cent, half away from zero, with thousands."""
    cents = F.round(F.abs(nano).cast("decimal(38,0)") / 10_000_000, 0)
    return F.concat(F.when(nano < 0, "-").otherwise(""), F.lit("$"), F.format_number(cents / 100, 2))


def compact_number(n: Column) -> Column:
    """9,999 and below as they are, then 12.3K, 4.56M, 7.89B."""
    plain = lambda x, digits: F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    return (
        F.when(n >= 1_000_000_000, F.concat(plain(n / 1e9, 2), F.lit("B"))).when(n >= 1_000_000, F.concat(plain(n / 1e6, 2), F.lit("M")))
        .when(n >= 10_000, F.concat(plain(n / 1e3, 1), F.lit("K"))).otherwise(F.format_number(n, 0))
    )


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_script(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("<!--"), F.lit("<\\!--"))


def truncate_bytes(text: Column, most: int) -> Column:
    """At most `most` bytes, cut at a character and marked with three dots."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most - 3)
    # Bytes of a character that was cut through go: a lead byte of n without n - 1 bytes after it.
    tail = F.regexp_extract(F.hex(cut), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F]){0,1}|[CD][0-9A-F])$", 0)
    even = F.length(tail) % 2 == 0
    whole = F.when(even & (F.octet_length(cut) > 0), F.substring(cut, F.lit(1), F.octet_length(cut) - (F.length(tail) / 2).cast("int"))).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(whole, "UTF-8"), F.lit("...")))


def one_of(value: Column, *known: str) -> Column:
    """Known values stay, null stays, others become 'unknown'."""
    return F.when(value.isin(*known), value).when(value.isNotNull(), "unknown")


def heat_glyph(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, "·░▒▓█")), level + 1)


def archetype(agent: Column, night: Column, minutes: Column, per_session: Column, projects: Column) -> Column:
    """The first rule that holds: shares of agent and night turns, mean minutes, turns a session, projects."""
    return (
        F.when(agent > 0.5, "Delegator").when(night > 0.5, "NightOwl").when(minutes > 120, "Marathoner").when((agent > 0.4) & (minutes > 60), "Architect")
        .when((minutes < 30) & (per_session > 10), "Sprinter").when(projects > 10, "Explorer").otherwise("Architect")
    )


# Labels and descriptions.
ARCHETYPES = {
    "Architect": ("The Architect", "You love orchestrating multi-agent teams for complex tasks."),
    "Sprinter": ("The Sprinter", "Short, intense bursts of productivity — you get in, get it done, and get out."),
    "NightOwl": ("The Night Owl", "The best code is written after dark. Your peak hours are when the world sleeps."),
    "Delegator": ("The Delegator", "You trust your agents more than yourself. Maximum delegation, maximum output."),
    "Explorer": ("The Explorer", "A polyglot of projects — always trying something new."),
    "Marathoner": ("The Marathoner", "You settle in for the long haul. Deep work sessions are your superpower."),
}


def archetype_text(kind: Column) -> tuple[Column, Column]:
    label, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (a, b) in ARCHETYPES.items():
        label, text = F.when(kind == k, a).otherwise(label), F.when(kind == k, b).otherwise(text)
    return label, text
