"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so neither links nor components ever meet in one task
or on the driver. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def _star(links: DataFrame, hubs: DataFrame) -> DataFrame:
    return links.join(hubs, "a")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``: for each node with a link, the smallest node that it reaches.

    Nodes are non-null values of one orderable type. Repeated links, both directions and self-links are allowed; an empty table gives an
    empty result. Rounds grow with the logarithm of the longest path; ``max_rounds`` only guards against a
    fault and raises if it is reached.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = materialize(edges, "links")
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _star(both, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        hub = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = _star(large, hub).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b")
        edges, was = pairs.where("a <> b").distinct(), path
        edges, path = materialize(edges, "links")
        remove(spark, was)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
