"""Chains in the graph of entries: each node names its parent within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def main_children(nodes: DataFrame) -> DataFrame:
    """(session, uuid, child): of a node's children the latest by ts (then the largest uuid), which a chain follows."""
    w = Window.partitionBy("session", "parent").orderBy(F.desc("ts"), F.desc("uuid"))
    kids = nodes.where("parent is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return kids.select("session", F.col("parent").alias("uuid"), F.col("uuid").alias("child"))


def _doubled(hop: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session, uuid, to, steps) after as many rounds of pointer doubling as the largest session needs: where each node gets to."""
    most = nodes.groupBy("session").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    for k in range(int(most - 1).bit_length()):
        far = hop.select("session", F.col("uuid").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        hop = hop.join(far, ["session", "to"], "left").select("session", "uuid", F.col("next").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if k % 4 == 3 and hop.sparkSession.conf.get("spark.checkpoint.dir", None):
            hop.sparkSession.sparkContext.setCheckpointDir(hop.sparkSession.conf.get("spark.checkpoint.dir"))
            hop = hop.checkpoint()
    return hop


def chain_lengths(nodes: DataFrame) -> DataFrame:
    """(session, uuid, length) of each chain from a root, or from a node whose parent is not in the session.

    nodes: (session, uuid, parent, ts), a uuid once a session. Every node is an edge to its main child; rounds of
    pointer doubling double how far each node sees, so a chain of n nodes takes log2(n) joins on (session, uuid)
    and a node is one row throughout. A cycle has no first node and no chain from elsewhere leads into it, as a node
    has one parent: cycles() tells what is in or under one.
    """
    n = nodes.select("session", "uuid", "parent", "ts")
    known = n.select("session", F.col("uuid").alias("parent"), F.lit(True).alias("inside"))
    n = n.join(known, ["session", "parent"], "left")
    heads = n.where("parent is null or inside is null").select("session", "uuid")
    hop = n.select("session", "uuid").join(main_children(n), ["session", "uuid"], "left").select("session", "uuid", F.col("child").alias("to"), F.when(F.col("child").isNotNull(), 1).otherwise(0).cast("long").alias("steps"))
    return heads.join(_doubled(hop, nodes), ["session", "uuid"]).select("session", "uuid", (F.col("steps") + 1).alias("length"))


def cycles(nodes: DataFrame) -> DataFrame:
    """(session, uuid) of the nodes whose parents never end: those of a cycle and those that hang on one.

    By pointer doubling towards the parents: a node that still has one after more steps than its session has nodes.
    """
    known = nodes.select("session", F.col("uuid").alias("parent"), F.col("uuid").alias("to"))
    hop = nodes.select("session", "uuid", "parent").join(known, ["session", "parent"], "left").select("session", "uuid", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("steps"))
    return _doubled(hop, nodes).where("to is not null").select("session", "uuid")


#: Lengths of chains that are counted together.
CHAIN_BUCKETS = ((0, 1), (2, 10), (11, 50), (51, 200), (201, 1000), (1001, None))


def bucketed(values: DataFrame, value: str, buckets=CHAIN_BUCKETS) -> DataFrame:
    """(bucket, low, high, n): how many values lie in each range, none too; high null: no end."""
    names = [(k, low, high, f"{low}..{high}" if high is not None else f">{low - 1}") for k, (low, high) in enumerate(buckets)]
    place = F.lit(None).cast("int")
    for k, low, high, _ in names:
        place = F.when(F.col(value).between(low, high) if high is not None else F.col(value) >= low, k).otherwise(place)
    counted = values.agg(*(F.count_if(place == k).alias(f"n{k}") for k, *_ in names))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"), F.col(f"n{k}").alias("n")) for k, low, high, name in names)))
    return counted.select(rows.alias("x")).select("x.*")
