"""Segmented scans against plain windows, selection against sorting, requests against windows, and the stream against the batch."""

import json
import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators.scan import carry_last, running_sum
from tallyloom.operators.selection import select_places
from tallyloom.operators.turns import collected_of_request, last_of_request
from tallyloom.sources import transcripts as T
from tallyloom.streaming import turns as S

from .test_transcripts import MAIN, NOW, home, turn  # noqa: F401


def exchanges(df):
    """(keys, what is below) of the plan's exchanges by hash."""
    lines = [re.sub(r"#\d+L?", "", x) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return [(m[1].rsplit(", ", 1)[0], below) for x, below in zip(lines, lines[1:], strict=False) if (m := re.search(r"Exchange hashpartitioning\((.*?)\), ", x))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scans_equal_windows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([None, None, "", f"t{n}"]), rng.choice([None, 1, 2, -3])) for n in rng.sample(range(400), 150)]
    df = spark.createDataFrame([*rows, ("c", 5, "only", 1), ("d", None, "no place", 1), ("d", 3, None, 2)], "g string, n int, text string, x int").repartition(5)
    w = Window.partitionBy("g").orderBy("n")
    want = df.withColumn("t", F.last("text", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("s", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    for size in (1, 7, 1000):
        block = F.floor(F.col("n") / size)
        got = running_sum(carry_last(df, ["g"], block, "n", F.col("text"), "t"), ["g"], block, "n", F.col("x"), "s")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_carry_over_splits_of_a_file(spark, tmp_path):
    """A file read in splits of 1 KB: the same texts as a window over the file, and no exchange by file but of summaries."""
    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    said = lambda k: {"type": "user", "uuid": f"p{k}", "sessionId": MAIN, "parentUuid": None, "message": {"role": "user", "content": f"text {k}" if k % 50 == 7 else ""}}
    lines = [json.dumps(x) for k in range(400) for x in ([said(k)] if k % 10 == 7 else []) + [turn(f"r{k}", k + 1)]]
    (folder / f"{MAIN}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        entries = T.entries(spark, str(tmp_path))
        got = T.records(entries, NOW)
        assert entries.select("line_pos.block").distinct().count() > 100
        kept = {r.request_id: r.user_text for r in got.collect()}
        dealt = exchanges(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, last = {}, None
    for x in map(json.loads, lines):
        if x["type"] == "user":
            last = x["message"]["content"] or last
        else:
            want[x["requestId"]] = last
    assert kept == want and len({*want.values()}) == 9
    assert any(k.startswith("path, __block") for k, _ in dealt)
    assert all("Aggregate" in below for k, below in dealt if k == "path")  # a row for each split or file at most


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_sorting(spark, seed):
    rng = random.Random(seed)
    values = [[rng.randrange(-50, 50) for _ in range(333)], [rng.getrandbits(60) - (1 << 59) for _ in range(200)], [7] * 40, [-(1 << 63) + 1, (1 << 63) - 1, 0, 0]][seed]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(3)
    places = {"low": lambda n: 0, "median": lambda n: n // 2, "p90": lambda n: n * 9 // 10, "high": lambda n: n - 1, "none": lambda n: n, "below": lambda n: -1}
    s, n = sorted(values), len(values)
    want = {"low": s[0], "median": s[n // 2], "p90": s[n * 9 // 10], "high": s[-1], "none": None, "below": None}
    assert select_places(df, "v", places) == want
    assert select_places(df.groupBy("v").agg(F.count("*").alias("n")), "v", places, "n") == want
    assert select_places(df.where("v is null"), "v", places) == dict.fromkeys(places)


COLS = "session_id string, file_id long, is_agent boolean, request_id string, line_pos long, output_tokens long, tool_names array<string>"


def test_last_of_request_equals_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice("st"), f := rng.choice([-1, 1]), f == 1, rng.choice(["r1", "r2", "r3", "", None]), n, n * 10, rng.choices(["Bash", "Edit"], k=n % 3)) for n in range(200)]
    df = spark.createDataFrame(rows, COLS).repartition(4)
    own = Window.partitionBy("session_id", "file_id", F.when(F.coalesce("request_id", F.lit("")) == "", F.col("line_pos").cast("string")).otherwise(F.concat(F.lit("r"), "request_id")))
    want = df.withColumn("last", F.max("line_pos").over(own)).withColumn("first", F.min("line_pos").over(own)).where("line_pos = last").withColumn("line_pos", F.col("first")).drop("last", "first")
    got = last_of_request(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert "partial_max_by" in got._jdf.queryExecution().executedPlan().toString()  # combined before the exchange


def test_collected_tool_names(spark):
    rows = [("s", -1, False, "r", 1, 1, ["Bash"]), ("s", -1, False, "r", 2, 2, ["Edit", "Edit"]), ("s", -1, False, "r", 3, 3, ["Bash"]), ("s", -1, False, None, 4, 4, ["Read"]), ("s", -1, False, "q", 5, 5, [])]
    got = {r.line_pos: r.tool_names for r in collected_of_request(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {1: ["Bash", "Edit", "Edit"], 4: ["Read"], 5: []}


def test_stream_ends_with_the_turns_of_the_batch(spark, home, tmp_path):  # noqa: F811
    """The fixture tree in micro-batches of two files: the same turns as in one go."""
    spark.conf.set(S.PROVIDER, S.ROCKS)
    try:
        updates = S.stream_turns(S.stream_records(spark, home, NOW, maxFilesPerTrigger="2"))
        at = str(tmp_path / "updates")
        query = updates.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(at)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        ended = query.awaitTermination(90)
        query.stop()
        batches = [p for p in query.recentProgress if p["numInputRows"]]
    finally:
        spark.conf.unset(S.PROVIDER)
    assert ended and len(batches) >= 3
    got = S.current(spark.read.parquet(at))
    shown = lambda df: sorted(map(str, df.select("session_id", "request_id", "output_tokens", "is_agent", "uuid", "model", "ts", "tool_names", "stop_reason", "project", "run_id").collect()))
    assert shown(got) == shown(T.turns(T.records(T.entries(spark, home), NOW)))
    with pytest.raises(ValueError, match="RocksDB"):
        S.stream_turns(S.stream_records(spark, home, NOW))


def test_idle_requests_leave_the_state(spark, tmp_path):
    """Two files of one request: after the timer, the second begins a version of its own."""
    folder = tmp_path / "projects" / "p"
    folder.mkdir(parents=True)
    put = lambda name, *rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows)) and (tmp_path / name).rename(folder / name)
    put(f"{MAIN}.jsonl", turn("r1", 1), turn("r1", 2))
    at = tmp_path / "updates"
    spark.conf.set(S.PROVIDER, S.ROCKS)
    try:
        updates = S.stream_turns(S.stream_records(spark, str(tmp_path), NOW), idle_ms=1)
        query = updates.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(str(at))).option("checkpointLocation", str(tmp_path / "state")).start()
        seen = lambda: [(r.version, r.output_tokens, r.line_pos) for r in spark.read.parquet(str(at)).orderBy("output_tokens").collect()] if list(at.glob("*.parquet")) else []
        waited(lambda: seen() == [(1, 2, 0)])
        before = query.lastProgress["batchId"]
        waited(lambda: query.lastProgress["batchId"] > before + 2)
        put("agent-a.jsonl", turn("r1", 9))
        waited(lambda: len(seen()) == 2)
        query.stop()
    finally:
        spark.conf.unset(S.PROVIDER)
    assert seen() == [(1, 2, 0), (1, 9, 0)]


def waited(ready, seconds=60):
    end = time.time() + seconds
    while not ready():
        assert time.time() < end, "nothing came"
        time.sleep(0.3)
