"""Embedding near-duplicates: int8 tile products with error bounds, exact where a pair may reach the threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, union_find

#: Vectors of a block; a task holds two blocks, so memory is bounded whatever the input.
BLOCK = 4096
STRIP = 256
#: Up to so many vector lengths are told apart by a literal map, more by a join.
LENGTHS = 1000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q, scales s, and for each unit vector u the norm of the error u - s q and of s q, both rounded up."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    slack = 1 + 1e-9
    return q, scale, np.linalg.norm(unit - back, axis=1) * slack + 1e-12, np.linalg.norm(back, axis=1) * slack


def linked(x: np.ndarray, y: np.ndarray, threshold: float):
    """(row, col) arrays of the pairs with cosine >= threshold, strip by strip.

    u.v differs from (s q).(t r) by |u - sq| |tr| + |v - tr| at most, as |u| = 1. Sums of int8 products are
    whole numbers below 2^24 for up to 1,040 dimensions, so float32 holds them exactly; beyond, float64 does.
    Only rows and columns with a pair whose upper bound reaches the threshold are multiplied in double precision.
    """
    u, v = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    (q, s, e, _), (r, t, d, n) = quantise(u), quantise(v)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    r_t, q = r.T.astype(kind), q.astype(kind)
    worst_t, worst_d, worst_n = t.max(), d.max(), n.max()
    for at in range(0, len(x), STRIP):
        rows = slice(at, at + STRIP)
        product = q[rows] @ r_t
        # Coarse: the bound with the block's worst column; then each pair's own.
        least = (threshold - e[rows] * worst_n - worst_d) / s[rows] / worst_t
        i, j = np.divmod(np.flatnonzero(product >= np.floor(np.maximum(least, 0))[:, None].astype(kind)), product.shape[1])
        own = product[i, j] * s[at + i] * t[j] + e[at + i] * n[j] + d[j] >= threshold - 1e-9
        i, j = i[own], j[own]
        if not len(i):
            continue
        some, to = np.unique(i, return_inverse=True)
        cols, tc = np.unique(j, return_inverse=True)
        cosine = x[at + some] @ y[cols].T / np.linalg.norm(x[at + some], axis=1)[:, None] / np.linalg.norm(y[cols], axis=1)
        real = cosine[to, tc] >= threshold
        yield at + i[real], j[real]


def _tiles(threshold: float):
    def run(key, rows):
        own, other = (int(k.as_py()) for k in key[:2])
        block = np.asarray(rows["block"])
        ids, count = np.asarray(rows["rep"]), np.asarray(rows["n"]).astype(np.int64)
        data = np.asarray(rows["embedding"].combine_chunks().flatten()).astype(np.float64).reshape(len(ids), -1)
        a, b = np.flatnonzero(block == own), np.flatnonzero(block == other)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for i, j in linked(data[a], data[b], threshold) if len(a) and len(b) else ():
            if own == other:
                i, j = i[i < j], j[i < j]
            i, j = a[i], b[j]
            links += np.bincount(i, count[j], len(ids)).astype(np.int64) + np.bincount(j, count[i], len(ids)).astype(np.int64)
            pair = np.unique(np.stack([root[i], root[j]]), axis=1)
            new = union_find(zip(*pair[:, pair[0] != pair[1]].tolist(), strict=True))
            if new:
                step = np.arange(len(ids))
                step[list(new)] = list(new.values())
                root = step[root]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        hit = links > 0
        return pa.table({"rep": ids[hit], "links": links[hit], "low": low[root][hit]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, by cosine >= threshold in double precision.

    Equal vectors are compared once, with their number of copies. The others are dealt into blocks of BLOCK,
    and each pair of blocks is one task's tile product. A tile returns link counts and a spanning star of
    each of its groups, never the pairs. Vectors that are null, empty, zero, or hold null or non-finite
    components, link with nothing; vectors of different lengths do not link. Repeated rows count as vectors
    of their own, those that share a vec_id too; a row with a null vec_id is returned and counts as a link, but
    names no component.
    """
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # as exact as given
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # +0.0: one zero for both signs.
    src = src.withColumn("embedding", F.when(fine, F.transform("embedding", lambda x: x + F.lit(0.0)).cast(f"array<{kind}>")))
    rep = src.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    # A class's key is its row's number in the written table: ids may be null or stand for several vectors.
    rep = materialize(rep.withColumn("rep", F.monotonically_increasing_id()))
    lengths = materialize(rep.groupBy(F.size("embedding").alias("dim")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("g")))
    dealt = rep.withColumn("dim", F.size("embedding"))
    few = lengths.limit(LENGTHS + 1).collect()
    if len(few) <= LENGTHS:  # mostly one: a literal of the plan
        dealt = dealt.withColumn("g", F.create_map(*[F.lit(x) for r in few for x in r])[F.col("dim")] if few else F.lit(1).cast("long"))
    else:
        dealt = dealt.join(lengths.hint("merge"), "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("g")).cast("int"))
    tiles = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), (F.col("g") - 1).cast("int")))).select(F.least("block", "with").alias("own"), F.greatest("block", "with").alias("other"), "dim", "block", "rep", "n", "embedding")
    found = materialize(tiles.groupBy("own", "other", "dim").applyInArrow(_tiles(threshold), "rep long, links long, low long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # A component's smallest key need not be that of its smallest id.
    group = rep.join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    low = group.groupBy("component").agg(F.min("low").alias("component_id"))
    done = group.join(low, "component").join(links, "rep", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = src.join(done, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
