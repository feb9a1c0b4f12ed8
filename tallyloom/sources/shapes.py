"""Kinds of entries and payloads, as column expressions over a parsed line `v` (variant). Nothing here fails on odd shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import one_of


def field(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def keys_of(v: Column) -> Column:
    """The sorted keys of an object, null for anything else."""
    return F.array_sort(F.json_object_keys(F.to_json(v)))


def kind_of(v: Column) -> Column:
    """null, bool, int, float, string, array or obj."""
    name = F.schema_of_variant(v)
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "bool").when(name == "STRING", "string").when(name.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "int")
        .when(F.startswith(name, F.lit("ARRAY")), "array").when(F.startswith(name, F.lit("OBJECT")), "obj").when(name.isNotNull(), F.when(F.rlike(name, F.lit(r"^DECIMAL\(\d+,0\)$")), "int").otherwise("float"))
    )


def shape(v: Column, depth: int = 0, deepest: int = 2) -> Column:
    """Signature of a JSON value: an object's sorted keys, the kinds of an array's first five elements, to a depth of two."""
    kind = kind_of(v)
    if depth >= deepest:
        return F.when(kind == "array", "array[?]").when(kind == "obj", "obj{?}").otherwise(kind)
    keys = keys_of(v)
    elements = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, 5)
    inner = F.array_join(F.array_sort(F.array_distinct(F.transform(elements, lambda e: shape(e, depth + 1, deepest)))), ",")
    array = F.when(F.size(elements) == 0, "array[empty]").otherwise(F.concat(F.lit("array["), inner, F.lit("]")))
    obj = F.when(F.size(keys) == 0, "obj{empty}").otherwise(F.concat(F.lit("obj{"), F.array_join(keys, ","), F.lit("}")))
    return F.when(kind == "array", array).when(kind == "obj", obj).otherwise(kind)


def content_kind() -> Column:
    """String, ToolResult, Text, ImageText or Mixed of a user entry's content; an empty array is Mixed, anything else null."""
    content = field("message.content", "variant")
    types = F.transform(field("message.content", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("?")))
    has = lambda t: F.array_contains(types, t)
    other = F.exists(types, lambda t: ~t.isin("tool_result", "text", "image"))
    return (
        F.when(kind_of(content) == "string", "String").when(types.isNull(), None)
        .when(has("tool_result") & ~has("text") & ~has("image") & ~other, "ToolResult").when(has("text") & ~has("tool_result") & ~has("image") & ~other, "Text")
        .when(has("image") & ~has("tool_result") & ~other, "ImageText").otherwise("Mixed")
    )


def user_kind() -> Column:
    """ToolResult where the entry says so itself or holds such a block, else RealInput."""
    named = field("toolUseResult", "variant").isNotNull() & (kind_of(field("toolUseResult", "variant")) != "null") | field("sourceToolUseID").isNotNull()
    block = F.coalesce(F.exists(field("message.content", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False))), F.lit(False))
    return F.when(F.coalesce(named, F.lit(False)) | block, "ToolResult").otherwise("RealInput")


# The keys that mark each kind of tool result, in the order in which they are tried.
TOOL_RESULTS = (
    ("TaskCompleted", ("agentId", "agentType", "content", "prompt", "status")),
    ("TaskAsync", ("isAsync", "agentId", "status", "outputFile")),
    ("TaskUpdate", ("statusChange", "success", "taskId", "updatedFields")),
    ("TaskCreate", ("task",)),
    ("Bash", ("interrupted", "isImage", "noOutputExpected", "stderr", "stdout")),
    ("Edit", ("filePath", "newString", "oldString", "originalFile", "replaceAll", "structuredPatch", "userModified")),
    ("Write", ("content", "filePath", "originalFile", "structuredPatch", "type", "userModified")),
    ("Read", ("file", "type")),
    ("AskUser", ("answers", "questions")),
    ("WebFetch", ("bytes", "code", "codeText", "durationMs", "result", "url")),
    ("WebSearch", ("durationSeconds", "query", "results")),
)
#: These fit only an object without further keys.
WHOLE = ("TaskCreate", "Read")
#: Types of the scalar fields; a result whose field has another one is Other.
SCALARS = {
    "string": ("agentId", "agentType", "prompt", "status", "taskId", "stderr", "stdout", "filePath", "newString", "oldString", "codeText", "url", "query", "outputFile"),
    "bool": ("isAsync", "success", "interrupted", "isImage", "noOutputExpected", "replaceAll", "userModified"),
    "int": ("bytes", "code", "durationMs"),
}


def tool_result_kind() -> Column:
    """Rejected (a plain string), one of TOOL_RESULTS by its keys, or Other; null without a result."""
    v = field("toolUseResult", "variant")
    kind, keys = kind_of(v), keys_of(v)
    out = F.lit("Other")
    wrong = F.lit(False)
    for expected, names in SCALARS.items():
        for n in names:
            own = kind_of(field(f"toolUseResult.{n}", "variant"))
            wrong = wrong | F.coalesce(~own.isin(expected, "null"), F.lit(False))
    for name, needed in reversed(TOOL_RESULTS):
        fits = F.size(F.array_except(F.array(*map(F.lit, needed)), keys)) == 0
        out = F.when(fits & (F.size(keys) == len(needed)) if name in WHOLE else fits, name).otherwise(out)
    return F.when(kind == "null", None).when(kind == "string", "Rejected").when((kind == "obj") & ~wrong, out).when(kind.isNotNull(), "Other")


# Known subtypes.
SUBTYPES = {
    "system": ("turn_duration", "stop_hook_summary", "away_summary", "api_error", "local_command", "compact_boundary", "informational", "scheduled_task_fire", "bridge_status"),
    "attachment": ("output_style", "hook_success", "task_reminder", "deferred_tools_delta", "skill_listing", "queued_command"),
    "progress": ("hook_progress", "agent_progress", "bash_progress", "mcp_progress", "search_results_received", "query_update"),
}


def subtype() -> Column:
    """Subtype of a system, attachment or progress entry; unfamiliar ones are 'unknown', a missing body is null."""
    kind = field("type")
    at = {"system": "subtype", "attachment": "attachment.type", "progress": "data.type"}
    out = F.lit(None).cast("string")
    for name, known in SUBTYPES.items():
        body = F.lit(True) if name == "system" else field(at[name].split(".")[0], "variant").isNotNull()
        out = F.when(kind == name, F.when(body, F.coalesce(one_of(field(at[name]), *known), F.lit("unknown")))).otherwise(out)
    return out


# The fields of each subtype and their types.
SYSTEM_FIELDS = {
    "turn_duration": {"durationMs": "bigint", "messageCount": "bigint"},
    "stop_hook_summary": {"hookCount": "bigint", "hookInfos": "array<struct<command:string,durationMs:bigint>>", "hookErrors": "array<variant>", "preventedContinuation": "boolean", "stopReason": "string", "hasOutput": "boolean", "level": "string"},
    "away_summary": {"content": "string"},
    "api_error": {"level": "string", "retryInMs": "double", "retryAttempt": "bigint", "maxRetries": "bigint"},
    "local_command": {"content": "string", "level": "string"},
    "compact_boundary": {"content": "string", "level": "string"},
    "informational": {"content": "string", "level": "string"},
    "scheduled_task_fire": {"content": "string"},
    "bridge_status": {"content": "string", "url": "string"},
}
ATTACHMENT_FIELDS = {
    "output_style": {"style": "string"},
    "hook_success": {"command": "string", "durationMs": "bigint", "exitCode": "bigint", "hookEvent": "string", "hookName": "string", "stderr": "string", "stdout": "string", "toolUseID": "string"},
    "task_reminder": {"itemCount": "bigint"},
    "deferred_tools_delta": {"addedNames": "array<string>", "removedNames": "array<string>"},
    "skill_listing": {"isInitial": "boolean", "skillCount": "bigint", "names": "array<string>"},
    "queued_command": {"commandMode": "string", "prompt": "string", "source_uuid": "string"},
}


def body_fields(kind: str) -> list[Column]:
    """Every field of the bodies of a kind ('system' or 'attachment'), null where the entry's subtype does not carry it."""
    table, prefix = (SYSTEM_FIELDS, "") if kind == "system" else (ATTACHMENT_FIELDS, "attachment.")
    names = {n: t for fields in table.values() for n, t in fields.items()}
    return [F.when((field("type") == kind) & subtype().isin(*[s for s, fields in table.items() if n in fields]), field(prefix + n, t)).alias(n) for n, t in names.items()]


def attachment_drifts() -> Column:
    """Whether a known attachment's body holds a field of another type: such a body counts as unknown, and is no error."""
    bad = F.lit(False)
    for name, fields in ATTACHMENT_FIELDS.items():
        for n, t in fields.items():
            own = field(f"attachment.{n}", "variant")
            bad = bad | ((field("attachment.type") == name) & own.isNotNull() & (kind_of(own) != "null") & field(f"attachment.{n}", t).isNull())
    return F.coalesce(bad, F.lit(False))


def attachment_subtype() -> Column:
    return F.when(field("type") == "attachment", F.when(attachment_drifts(), "unknown").otherwise(subtype()))


def agent_id() -> Column:
    """The entry's own agentId, else the one of its tool result if that is not empty."""
    return F.coalesce(field("agentId"), F.nullif(field("toolUseResult.agentId"), F.lit("")))
