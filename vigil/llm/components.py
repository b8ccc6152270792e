"""Connected components of a graph of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import storage

#: A node with this many edges, and with this part of all edges, is a hub; edges of each node are then dealt over so many tasks.
HUB_EDGES, HUB_PART, SALTS = 256, 4_096, 8


def _towards_least(edges: DataFrame, keep_all: bool, salts: int) -> DataFrame:
    """Links the neighbours of every node to the least of them and the node, whose edges meet it in salts places."""
    nodes = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if salts == 1:
        linked = edges.join(nodes, "u")
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
        linked = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts))).join(nodes.select("*", every), ["u", "salt"])
    out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(nodes.where("u <> m").select("u", F.col("m").alias("v"))) if keep_all else linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of longs: node, component (the least node reachable), for all nodes with an edge.

    Loops count as nodes without edges and repeated edges as one.  Every round is written to the
    shared folder, so that a lost executor never replays more than one round.  While there is a hub, no node's edges go to one task;
    the small-star step has none that the large-star step has not, since it only moves the lesser ends of edges.
    """
    current = storage.materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    total = current.count()
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = both.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        salts = SALTS if most >= max(HUB_EDGES, total // HUB_PART) else 1
        large = _towards_least(both, keep_all=False, salts=salts).where("u <> v").distinct()
        small = _towards_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keep_all=True, salts=salts).distinct()
        after = storage.materialise(small, "edges")
        storage.release_table(current)
        current = after
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark, total = seen, seen[0]
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
