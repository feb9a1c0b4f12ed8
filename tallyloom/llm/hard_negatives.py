"""Hard negatives: whole-number inner products by a block matrix multiplication over rows and dimensions, and the best of each tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors and rows of a tile: 4 MB of int64 scores, whatever the input.
ANCHORS, ROWS = 256, 2048
#: Dimensions of a chunk, at least; more where vectors are long, so that a tile is the sum of at most CHUNKS.
DIMS, CHUNKS = 32, 8
#: Labels are dealt over so many groups, each with its own number of blocks.
GROUPS = 64
PARTIAL = "g int, i int, j int, c int, a_id array<long>, a_key array<long>, a_label array<long>, b_id array<long>, b_key array<long>, b_label array<long>, p_at array<long>, p_id array<long>, p_key array<long>, p_score array<long>, tile binary"
META = ("a_id", "a_key", "a_label", "b_id", "b_key", "b_label", "p_at", "p_id", "p_key", "p_score")


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, key, label, q of the rows that take part, each once; q: floor(256 x) of each component, within what keeps a hundred times a score below 2^63."""
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    src = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    most = F.floor(F.sqrt(F.lit(2.0**56) / F.greatest(F.size("embedding"), F.lit(1))))
    q = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x * 256), -most), most))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return src.select("vec_id", label.alias("label"), q.alias("q")).distinct().withColumn("key", F.xxhash64("label", "q"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64, exactly: in double precision where no sum can reach 2^53."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _multiply(key, rows):
    """One tile's partial scores over one chunk of dimensions; who its rows and columns are is told by the first chunk only."""
    g, i, j, c = (k.as_py() for k in key)
    ids, keys, anchor = (np.asarray(rows[n]) for n in ("vec_id", "key", "anchor"))
    q = np.asarray(rows["part"].combine_chunks().flatten()).reshape(len(ids), -1)
    order = np.lexsort((keys, ids))
    a, b = order[anchor[order]], order[~anchor[order]]
    meta = dict.fromkeys(META)
    if c == 0:
        label = np.asarray(rows["label"])
        meta |= {"a_id": ids[a], "a_key": keys[a], "a_label": label[a], "b_id": ids[b], "b_key": keys[b], "b_label": label[b]}
        found = [(at, p["id"], p["key"], p["score"]) for at, ps in enumerate(rows["positives"].take(pa.array(a)).to_pylist()) for p in ps or ()]
        meta |= {n: np.array([x[k] for x in found], np.int64) for k, n in enumerate(("p_at", "p_id", "p_key", "p_score"))}
    tile = product(q[a], q[b]).tobytes() if len(a) and len(b) else b""
    columns = [pa.array([v], pa.int32()) for v in (g, i, j, c)] + [pa.array([meta[n]], pa.list_(pa.int64())) for n in META] + [pa.array([tile], pa.binary())]
    return pa.table(dict(zip(("g", "i", "j", "c", *META, "tile"), columns, strict=True)))


def _added(rows) -> tuple[dict, np.ndarray] | None:
    """A tile's scores, summed over its chunks, and who its rows and columns are; None if it has no scores."""
    at = rows["c"].to_pylist().index(0)
    meta = {n: np.asarray(rows[n][at].values) for n in META}
    if not len(meta["a_id"]) or not len(meta["b_id"]):
        return None
    total = np.zeros((len(meta["a_id"]), len(meta["b_id"])), np.int64)
    for tile in rows["tile"]:
        total += np.frombuffer(tile.as_buffer(), np.int64).reshape(total.shape)
    return meta, total


def best(score: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of those that fit, highest first, ties by place."""
    at = np.flatnonzero(fit)
    s = score[at]
    if len(at) > k:
        at = at[s >= np.partition(s, len(at) - k)[len(at) - k]]
        s = score[at]
    return at[np.argsort(-s, kind="stable")[:k]]


def _positives(k: int):
    def run(key, rows):
        out = []
        if found := _added(rows):
            m, score = found
            for r in range(len(score)):
                other = (m["b_label"] == m["a_label"][r]) & ((m["b_id"] != m["a_id"][r]) | (m["b_key"] != m["a_key"][r]))
                out += [(m["a_id"][r], m["a_key"][r], m["b_id"][c], m["b_key"][c], score[r, c]) for c in best(score[r], other, k)]
        return pa.table({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(("a_id", "a_key", "id", "key", "score"))})

    return run


def _negatives(k: int, low: int, high: int):
    def run(key, rows):
        out = []
        if found := _added(rows):
            m, score = found
            hundred = score * 100
            for r, p_id, p_key, p in zip(m["p_at"], m["p_id"], m["p_key"], m["p_score"], strict=True):
                fit = (m["b_label"] != m["a_label"][r]) & (hundred[r] >= low * p) & (hundred[r] <= high * p)
                out += [(m["a_id"][r], m["a_key"][r], p_id, p_key, p, m["b_id"][c], m["b_key"][c], score[r, c]) for c in best(score[r], fit, k)]
        return pa.table({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(("a_id", "a_key", "p_id", "p_key", "p_score", "n_id", "n_key", "n_score"))})

    return run


def partial_tiles(anchors: DataFrame, rows: DataFrame, blocks: dict[int, tuple[int, int]], width: int, chunks: int) -> DataFrame:
    """Partial scores of every block of a group's anchors with every block of its rows, chunk by chunk of the dimensions.

    Both sides have g (group), vec_id, key, label, q; anchors have positives. blocks: of each group, the number of
    anchor blocks and of row blocks. Every row meets each anchor block once, as whole blocks; pairs are never rows.
    """
    counts = {g: n for g, n in blocks.items() if n[0] and n[1]}
    if not counts:
        return rows.sparkSession.createDataFrame([], PARTIAL)
    n = [F.create_map(*[F.lit(x) for g, v in counts.items() for x in (g, v[side])])[F.col("g")] for side in (0, 1)]
    own = lambda side: F.pmod(F.xxhash64("vec_id", "key", F.lit(side)), n[side]).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), n[side] - 1))
    positives = "array<struct<score:long,id:long,key:long>>"
    a = anchors.where(n[0].isNotNull()).withColumn("i", own(0)).withColumn("j", every(1)).withColumn("anchor", F.lit(True)).select("g", "i", "j", "anchor", "vec_id", "key", "label", F.col("positives").cast(positives).alias("positives"), "q")
    b = rows.where(n[0].isNotNull()).withColumn("j", own(1)).withColumn("i", every(0)).withColumn("anchor", F.lit(False)).select("g", "i", "j", "anchor", "vec_id", "key", "label", F.lit(None).cast(positives).alias("positives"), "q")
    cut = F.slice("q", F.col("c") * width + 1, F.lit(width))
    part = F.concat(cut, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(cut)))
    both = a.unionByName(b).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("g", "i", "j", "c", "anchor", "vec_id", "key", "label", F.when(F.col("c") == 0, F.col("positives")).alias("positives"), part.alias("part"))
    return both.groupBy("g", "i", "j", "c").applyInArrow(_multiply, PARTIAL)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`. First the anchors of a label meet the rows of that
    label, for the positives; then, in blocks of their own, all rows, for the negatives in each positive's window.
    Rows without a vec_id, a label or a vector, or with null or non-finite components, take no part; rows equal in
    vec_id, label and whole-number vector are one row, others that share a vec_id are rows of their own. Vectors
    of different lengths are compared as if the shorter one had zeros behind it; an empty vector scores 0. A
    component counts as the nearest number that cannot overflow (beyond 131,072 for 64 dimensions). An anchor
    without positives, or a positive without negatives in its window, has no rows; an empty table has none.
    """
    rows = materialize(integer_rows(embeddings).withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")))
    is_anchor = F.col("vec_id") % every == 0
    sizes = rows.groupBy("g").agg(F.count_if(is_anchor).alias("a"), F.count("*").alias("b"), F.max(F.size("q")).alias("dim")).collect()  # GROUPS rows at most
    dim = max((r.dim for r in sizes), default=0)
    width = max(DIMS, -(-dim // CHUNKS))
    chunks = max(1, -(-dim // width))
    blocks = {r.g: (-(-r.a // ANCHORS), -(-r.b // ROWS)) for r in sizes}
    anchors = rows.where(is_anchor)
    top = partial_tiles(anchors.withColumn("positives", F.lit(None)), rows, blocks, width, chunks).groupBy("g", "i", "j").applyInArrow(_positives(positives), "a_id long, a_key long, id long, key long, score long")
    order = Window.partitionBy("a_id", "a_key").orderBy(F.desc("score"), "id", "key")
    top = top.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    chosen = materialize(top.groupBy(F.col("a_id").alias("vec_id"), F.col("a_key").alias("key")).agg(F.collect_list(F.struct("score", "id", F.col("key").alias("key"))).alias("positives")))
    whole = {0: (-(-sum(r.a for r in sizes) // ANCHORS), -(-sum(r.b for r in sizes) // ROWS))}
    one = lambda df: df.withColumn("g", F.lit(0))
    found = partial_tiles(one(anchors.join(chosen, ["vec_id", "key"])), one(rows), whole, width, chunks).groupBy("g", "i", "j").applyInArrow(_negatives(negatives, low, high), "a_id long, a_key long, p_id long, p_key long, p_score long, n_id long, n_key long, n_score long")
    order = Window.partitionBy("a_id", "a_key", "p_id", "p_key").orderBy(F.desc("n_score"), "n_id", "n_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))


#: The definition, pair by pair.
ORACLE_SQL = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label as other, list_inner_product(a.q, b.q)::bigint as score from rows a join rows b on a.vec_id % 100 = 0),
positives as (select anchor_id, own, id as positive_id, score as positive_score from scored where own = other and id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) as rank, n.id as negative_id, p.positive_score, n.score as negative_score
    from positives p join scored n on n.anchor_id = p.anchor_id and n.own <> n.other and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
