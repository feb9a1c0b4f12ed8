"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, materialize

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A bucket of up to so many fingerprints is compared pair by pair; larger ones go through the full ball.
SMALL_BUCKET = 32


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size).tolist()
        h, end = xxhash.xxh64_intdigest, end.tolist()
        hashes = [h(joined[a:b], 42) for a, b in zip(start, end[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def row_key() -> Column:
    """A key of a row by its doc_id and text, each of which may be null; only equal rows share one."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def fingerprints(docs: DataFrame, shingle: int = 4, key: Column | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and the long `key` if one is given. A null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *["key"] * (b.num_columns - 2)])

    own = [] if key is None else [key.alias("key")]
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(run, "doc_id long, fp long" + ", key long" * len(own))


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of up to `radius` of `width` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _emit_variants(masks: list[np.ndarray], shifts: list[int], width: int, near: int = 64):
    """(key, fp, near): every variant of every part; near: whether at most `near` bits are flipped."""
    low = np.uint64((1 << width) - 1) if width < 64 else np.uint64((1 << 64) - 1)

    def run(batches):
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                for k, (m, s) in enumerate(zip(masks, shifts, strict=True)):
                    key = (((part >> np.uint64(s)) & low)[:, None] ^ m).ravel()
                    tag = np.uint64(k) << np.uint64(width) if width < 63 else np.uint64(0)
                    close = np.tile(np.bitwise_count(m) <= near, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array((key | tag).view(np.int64)), pa.array(np.repeat(part, len(m)).view(np.int64)), pa.array(close)], names=["key", "fp", "near"])

    return run


def _bucket_pairs(radius: int):
    """Over rows sorted by key: verified pairs (a, b) of small buckets, and (fp, null) for each member of a large one."""

    def emit(key, fp):
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        of = np.repeat(size, size)
        big = of > SMALL_BUCKET
        small = np.flatnonzero((of > 1) & ~big)
        a, b = [], []
        k, f = key[small], fp[small]
        for d in range(1, SMALL_BUCKET):
            if len(k) <= d:
                break
            hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
            a.append(f[hit])
            b.append(f[hit + d])
        a, b = np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])
        hot = np.unique(fp[big])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, hot]).view(np.int64)), pa.array(np.concatenate([b, hot]).view(np.int64), mask=np.append(np.zeros(len(a), bool), np.ones(len(hot), bool)))], names=["a", "b"])

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        long_key = None  # of a bucket that is already known to be large: its rows go out as they come
        for batch in batches:
            key = np.concatenate([key, np.asarray(batch.column(0))])
            fp = np.concatenate([fp, np.asarray(batch.column(1)).view(np.uint64)])
            if long_key is not None:
                n = int(np.searchsorted(key, long_key, "right"))
                if n:
                    hot = np.unique(fp[:n]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hot), pa.nulls(len(hot), pa.int64())], names=["a", "b"])
                key, fp = key[n:], fp[n:]
                long_key = long_key if not len(key) else None
            if not len(key):
                continue
            n = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - n > SMALL_BUCKET:
                long_key, n = key[-1], len(key)
            yield from emit(key[:n], fp[:n])
            key, fp = key[n:], fp[n:]
        yield from emit(key, fp)

    return run


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within `radius` bits.

    Meet in the middle: two fingerprints within the radius share a variant within half of it, rounded down on
    one side and up on the other. The plain form emits every variant of all 64 bits - members that share one,
    one of them by the smaller half, are within the radius of each other, so a star around such a member is
    exact - but 2,081 rows a fingerprint at radius 4. So the bits are first split in halves, one of which
    differs in radius/2 bits at most: each half emits its variants within half of that, rounded up (66 rows in
    all at radius 4), colliding pairs of a bucket are verified, and only the members of large buckets emit
    their full ball. Every linked pair shares a small bucket or is in the full ball together.
    """
    spark = fps.sparkSession
    fps = fps.select("fp").distinct()
    half = flips(32, (radius // 2 + 1) // 2)
    # Dealt out first: a few small partitions would each become as many rows times the variants.
    spread = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = spread.mapInArrow(_emit_variants([half, half], [0, 32], 32), "key long, fp long, near boolean").drop("near")
    found = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_pairs(radius), "a long, b long").distinct())
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    ball = hot.mapInArrow(_emit_variants([flips(64, (radius + 1) // 2)], [0], 64, radius // 2), "key long, fp long, near boolean")
    low = ball.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.min("fp").alias("y"), F.max("fp").alias("z")).where("y <> z and a is not null").select("key", "a")
    star = ball.join(low.hint("merge"), "key").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return found.where("b is not null").unionByName(star)


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts, and texts without words, have fingerprint zero and link like any other.
    Repeated rows give repeated rows; a row with a null doc_id is returned, and its component is the
    smallest non-null doc_id (null where there is none). Only doc_id and text are read.
    """
    fps = materialize(fingerprints(docs, shingle))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(ball_links(own, radius))
    joined = own.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = joined.join(low.hint("merge"), "component").select("fp", "component_id")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group: one of each, whatever its doc_id.

    First is the smallest doc_id, null behind all others, and then the smallest row_key(). So rows of one
    doc_id with other texts are judged apart, and rows equal in doc_id and text become one.
    """
    fps = materialize(fingerprints(docs, shingle, row_key()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own = fps.groupBy("fp").agg(F.min(first).alias("low"))
    comp = components(ball_links(own, radius)).withColumnRenamed("node", "fp")
    lows = own.join(comp.hint("merge"), "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("low").alias("low"))
    kept = materialize(lows.select(F.col("low.key").alias("__key")))
    return docs.withColumn("__key", row_key()).join(kept.hint("merge"), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
