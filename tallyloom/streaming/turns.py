"""The dedup of turns as a stream: the last record of each request, held in state until it has been quiet for a while.

Updates come as rows of (session_id, request, version): the highest version of a request replaces what earlier ones
said, so an agent's turn goes when its session's main file turns out to hold the request too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.turns import request_key
from ..sources.transcripts import in_sessions, parsed, record_rows, source_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATES = "session_id string, request string, version long, file_id string, line_pos long, record string"


class LastOfRequest(StatefulProcessor):
    """Of one request of a session: for each file its first place, its last place and the record there.

    A main file's records hide the agents'. After idle_ms without a record the state goes; a record that comes later
    still begins a new version 1, so idle_ms must exceed the time over which a request is written. None: it stays.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_id string", "first long, last long, is_agent boolean, record string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.sort_values("line_pos").itertuples(index=False):
                old = self.files.getValue((r.file_id,)) if self.files.containsKey((r.file_id,)) else None
                at, record = (r.line_pos, r.record) if old is None or r.line_pos >= old[1] else (old[1], old[3])
                self.files.updateValue((r.file_id,), (int(min(r.line_pos, r.line_pos if old is None else old[0])), int(at), bool(r.is_agent), record))
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        held = [(k[0], *v) for k, v in self.files.iterator()]
        main = [x for x in held if not x[3]]
        yield pd.DataFrame([(key[0], key[1], version, x[0], x[1], x[4]) for x in main or held], columns=["session_id", "request", "version", "file_id", "line_pos", "record"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.files.clear()
        self.version.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_records(spark: SparkSession, home: str, now: str, **options) -> DataFrame:
    """The records of transcript files as they appear below home, each file once, with a line's number as its place.

    A file is read as one value, as only that numbers its lines in a stream: files of at most 2 GB. What a batch
    query carries from line to line (user_text) is not here. options: of the file source (maxFilesPerTrigger).
    """
    text = spark.readStream.format("text").schema("value string").options(pathGlobFilter="*.jsonl", recursiveFileLookup="true", wholetext="true", **options).load(f"{home}/projects")
    whole = text.select(source_path().alias("path"), "value", F.try_variant_get(F.try_parse_json(F.split_part("value", F.lit("\n"), F.lit(1))), "$.sessionId", "string").alias("named"))
    lines = in_sessions(whole).select("*", F.posexplode(F.split("value", "\n")).alias("n", "line")).drop("value", "named")
    at = F.struct(F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("n"))
    return record_rows(parsed(lines.withColumns({"value": F.col("line"), "line_pos": at}).drop("line", "n")), now).where("entry_type = 'assistant'").drop("said", "entry_type")


def stream_turns(records: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Updates of turns: session_id, request, version and the turn's columns. Needs the RocksDB state store, and Update as the sink's mode.

    idle_ms: as in LastOfRequest. With it the query waits for timers and so never ends by itself, also under
    trigger(availableNow=True). Records with an empty id are turns of their own, whatever the main file holds.
    """
    if records.sparkSession.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}: timers and maps are kept there")
    valid = records.where("skip_reason is null").drop("skip_reason", "is_sidechain")
    # Records without an id have keys of their own: of their file too, as requests meet across files.
    own = F.when(F.coalesce("request_id", F.lit("")) == "", F.concat_ws("\u0000", F.lit(""), "path", request_key())).otherwise(F.col("request_id"))
    rows = valid.select("session_id", own.alias("request"), F.col("file_id").cast("string").alias("file_id"), F.col("line_pos.n").alias("line_pos"), "is_agent", F.to_json(F.struct(*valid.columns)).alias("record"))
    updates = rows.groupBy("session_id", "request").transformWithStateInPandas(LastOfRequest(idle_ms), UPDATES, "Update", "None" if idle_ms is None else "ProcessingTime")
    kept = updates.withColumn("r", F.from_json("record", valid.schema))
    names = [F.col(f"r.{c}").alias(c) for c in valid.columns if c not in ("session_id", "file_id", "line_pos")]
    return kept.select("session_id", "request", "version", "file_id", "line_pos", *names)


def current(updates: DataFrame) -> DataFrame:
    """The turns that a table of updates amounts to: of each request the rows of its highest version."""
    last = updates.groupBy("session_id", "request").agg(F.max("version").alias("version"))
    return updates.join(last, ["session_id", "request", "version"], "left_semi").drop("request", "version")
