"""Helpers the operators share: tables, shared scratch tables, graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signed(x: int) -> int:
    """An unsigned 64-bit value as the signed long that Spark stores."""
    return x - (1 << 64) if x >> 63 else x


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode, where all is one machine, a temporary one if none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables of materialize() that are not released yet.
_tables: list[DataFrame] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _tables.append(out)
    return out


def forgotten(df: DataFrame) -> DataFrame:
    """materialize(), after which the shuffle files behind the table go: the cleaner deletes them once the driver has collected what refers to them."""
    out = materialize(df)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that no later read needs."""
    spark, path = df.sparkSession, df._scratch_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    _tables[:] = [t for t in _tables if t is not df]


def finished(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of build() as a table; every scratch table that was made on the way to it is deleted."""
    before = {id(t) for t in _tables}
    out = materialize(build())
    for t in [t for t in _tables if id(t) not in before and t is not out]:
        release(t)
    return out


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes too: 10,000 long texts in one batch are what fills an executor's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df


def slices(batches, column: int, most: int = 2_000_000):
    """Slices of Arrow batches whose string column holds at most `most` bytes, or one row: what a task holds as Python objects is bounded by bytes, not by rows."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        end, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def union_find(pairs) -> dict:
    """Root of each node (the smallest of its group) for an iterable of pairs."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _local_forest(batches):
    """Per batch, the same connections with at most one edge a node."""
    for b in batches:
        if b.num_rows:
            roots = union_find(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            kept = [(x, r) for x, r in roots.items() if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b: long) -> (node, component = smallest node reachable).

    Each round first shrinks every batch of edges to a spanning forest, then lets every node point
    its neighbours to its smallest neighbour (large star) and itself with its smaller neighbours to
    the smallest of them (small star), until all edges lead to a root. Minima are aggregates with
    map-side combine, so a hub node costs a skew join at most. Nodes without an edge are not returned.
    """

    def hooked(e: DataFrame, smaller: bool) -> DataFrame:
        # e: (u, v) neighbours; smaller: only neighbours below u take part, and u itself follows.
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = e.join(low.hint("merge"), "u")  # as large as the input: never to be broadcast
        if smaller:
            return out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_local_forest, "a long, b long").distinct())
    while True:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = hooked(both, False).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        new = materialize(hooked(down, True).where("a <> b").distinct())
        # Done when no root of an edge is the child of another edge and every child has one root.
        roots = new.select(F.col("b").alias("a")).distinct()
        stable = new.join(roots.hint("merge"), "a", "left_semi").limit(1).count() == 0 and new.groupBy("a").count().where("count > 1").limit(1).count() == 0
        release(cur)
        cur = new
        if stable:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


BLOOM_BITS = 1 << 23


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """A bit field of fixed size (1 MB whatever the number of keys) over xxhash64 of a key column.

    A key of `keys` always tests true; others may. It only spares later shuffles rows: the exact
    join follows. Aggregated on the executors, at most 256 rows of 4 KB reach the driver.
    """
    bit = F.pmod(F.xxhash64(col), F.lit(BLOOM_BITS)).cast("long")
    rows = keys.select((F.floor(bit / 32768)).cast("long").alias("bucket"), F.pmod(bit, F.lit(32768)).cast("long").alias("pos")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(pos)").alias("bits")).collect()
    field = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in rows:
        field[r.bucket * 4096 : r.bucket * 4096 + len(r.bits)] |= np.frombuffer(bytes(r.bits), np.uint8)
    return field


def maybe_in(df: DataFrame, col: str, field: np.ndarray) -> DataFrame:
    """Rows of df that pass key_filter's field, tested in the JVM's hash and an Arrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    names = df.columns

    def keep(batches):
        bits = shared.value
        for b in batches:
            at = np.asarray(b.column(len(names)))
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = b.filter(pa.array(hit.astype(bool)))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays(out.columns[: len(names)], names=names)

    return df.withColumn("__bit", F.pmod(F.xxhash64(col), F.lit(BLOOM_BITS)).cast("long")).mapInArrow(keep, df.schema)
