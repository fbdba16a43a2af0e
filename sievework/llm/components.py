"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import cut


#: Links up to which one task takes them all: shuffling so few takes longer. The bound does not grow with the input.
FEW = 200_000


def _large_star(edges: DataFrame, gathered) -> DataFrame:
    both = gathered(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # A neighbour above u hangs on the smallest node that u sees.
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, gathered) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gathered(rest.unionByName(low.select("u", F.col("m").alias("v")))).distinct()


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is its smallest node.

    Each round joins edges with each node's smallest neighbour; a hub's edges share a join key, which
    adaptive execution splits, and are never gathered into a list. Rounds grow with the logarithm of the
    largest component. Up to FEW links are one task's, without a shuffle. Self links, repeated links and an empty input are fine: a node with only self
    links has no row.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    gathered = (lambda df: df.coalesce(1)) if state[0] <= FEW else (lambda df: df)  # links never become more
    edges = gathered(edges)
    while state[0]:
        edges = gathered(cut(_small_star(_large_star(edges, gathered), gathered)))
        if (now := _state(edges)) == state:
            break
        state = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return gathered(pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))).distinct()
