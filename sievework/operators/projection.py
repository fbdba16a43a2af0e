"""A map of vectors in two dimensions that keeps neighbours together, and the maps made before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import distance
from sievework.operators import cells, embeddings
from sievework.operators.scratch import cut
from sievework.sources.writers import number_rows

#: Pairs of each point: nearest ones, second nearest of CHOICE random ones, random ones.
NEAR, MIDDLE, CHOICE, FAR = 10, 3, 6, 12
#: Rounds after which blocks see each other's positions, and steps of a block in a round.
ROUNDS, STEPS = 15, 25


def _pairs(points: DataFrame, n: int, block: int, seed: int) -> DataFrame:
    """(i, j, kind): what pulls each point i strongly (0), pulls it weakly (1) and pushes it (2)."""
    lists = cells.neighbours(points.select(F.col("i").alias("k"), "v"), None, min(NEAR, n - 1), block).lists
    near = lists.select(F.col("k").alias("i"), F.explode("near").alias("o")).select("i", F.col("o.o").alias("j"), F.lit(0).alias("kind"))
    some = lambda what, count: F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.pmod(F.xxhash64("i", F.lit(f"{seed}:{what}:{c}")), F.lit(n)).alias("j")) for c in range(count)])).alias("p")
    drawn = points.select("i", F.col("v").alias("a"), some("middle", MIDDLE * CHOICE)).select("i", "a", F.floor(F.col("p.c") / CHOICE).alias("s"), F.col("p.j").alias("j"))
    met = drawn.join(points.select(F.col("i").alias("j"), F.col("v").alias("b")), "j").where("i <> j").select("i", "s", "j", distance(F.col("a"), F.col("b")).alias("d"))
    second = met.groupBy("i", "s").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("o"))  # CHOICE at most
    middle = second.select("i", F.coalesce(F.get("o", F.lit(1)), F.get("o", F.lit(0)))["j"].alias("j"), F.lit(1).alias("kind"))
    far = points.select("i", some("far", FAR)).select("i", F.col("p.j").alias("j"), F.lit(2).alias("kind")).where("i <> j")
    return near.unionByName(middle).unionByName(far)


def _weights(at: float) -> tuple[float, float, float]:
    """How strongly the three kinds of pairs count when a share `at` of the rounds is done: first the whole, then neighbourhoods."""
    if at < 1 / 3:
        return 2.0, 1000 ** (1 - 3 * at) * 3 ** (3 * at), 1.0
    return (3.0, 3.0, 1.0) if at < 2 / 3 else (1.0, 0.0, 1.0)


def _moved(mine: pd.DataFrame, pairs: pd.DataFrame, done: int, steps: int, total: int) -> pd.DataFrame:
    """A block's points after some gradient steps with momentum, of `total` of which some were done before; what lies in other blocks stays where it is."""
    own = mine["i"].to_numpy()
    place = pd.Series(np.arange(len(own)), index=own)
    a, inside = place[pairs["i"]].to_numpy(), place.reindex(pairs["j"]).to_numpy()
    abroad = np.isnan(inside)
    fixed = pairs.loc[abroad, ["to_x", "to_y"]].to_numpy(np.float64)
    b = np.where(abroad, len(own) + np.cumsum(abroad) - 1, np.nan_to_num(inside)).astype(np.int64)
    kind = pairs["kind"].to_numpy()
    at, m, v = (mine[list(c)].to_numpy(np.float64).copy() for c in (("x", "y"), ("mx", "my"), ("vx", "vy")))
    for step in range(done + 1, done + steps + 1):
        near, middle, far = _weights((step - 1) / total)
        away = at[a] - np.r_[at, fixed][b]
        d = 1 + (away**2).sum(axis=1)
        pull = np.select([kind == 0, kind == 1], [near * 20 / (10 + d) ** 2, middle * 20_000 / (10_000 + d) ** 2], -far * 2 / (1 + d) ** 2)
        grad = np.stack([np.bincount(a, pull * away[:, c], len(own)) for c in (0, 1)], axis=1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        at -= m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return mine.assign(x=at[:, 0], y=at[:, 1], mx=m[:, 0], my=m[:, 1], vx=v[:, 0], vy=v[:, 1])


def _mover(done: int, steps: int, total: int):
    def move(_, mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        mine, held = mine.sort_values("i"), held.sort_values(["i", "kind", "j"])
        if not len(mine) or not len(held):
            return mine
        return _moved(mine, held, done, steps, total)

    return move


def project(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 4_096, seed: int = 0, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """(key, x, y): positions at which each vector's nearest others are near and random others are away.

    Starts from the principal components. In each round a task moves the points of one block (a ring of a cell of like
    vectors) by their own pairs, towards the positions that the other points had after the round
    before; so a task holds one block with its pairs, and a round is one join and one grouping. The same input and
    seed give the same map up to rounding. Up to three vectors are placed by `embeddings.project` alone. Keys
    must differ; null keys and vectors are left out.
    """
    held = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    n = held.count()
    if n <= 3:
        return embeddings.project(held, "k", "v").withColumnRenamed("k", key)
    points = number_rows(held, ["k"], "i")
    if n > block:
        placed = cells.place(points.select(F.col("i").alias("k"), "v"), cells.choose_pivots(points.select(F.col("i").alias("k"), "v"), max(1, min(cells.PIVOTS, n // block))), block)
        blocks = placed.select(F.col("k").alias("i"), "block")
    else:
        blocks = points.select("i", F.lit(0).cast("long").alias("block"))
    start = embeddings.project(points.select("i", "v"), "i", "v")
    spread = start.agg(F.greatest(F.stddev("x"), F.lit(1e-9)).alias("s"))  # one row
    at = cut(start.join(F.broadcast(spread)).join(blocks, "i").select("i", (F.col("x") / F.col("s") * 0.01).alias("x"), (F.col("y") / F.col("s") * 0.01).alias("y"), *[F.lit(0.0).alias(c) for c in ("mx", "my", "vx", "vy")], "block"))
    pairs = cut(_pairs(points, n, block, seed).join(blocks.withColumnRenamed("block", "own"), "i"))
    for r in range(rounds):
        ends = at.select(F.col("i").alias("j"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
        at = cut(at.groupBy("block").cogroup(pairs.join(ends, "j").groupBy("own")).applyInPandas(_mover(r * steps, steps, rounds * steps), "i long, x double, y double, mx double, my double, vx double, vy double, block long"))
    return points.select("i", "k").join(at, "i").select(F.col("k").alias(key), "x", "y")


def kept_projection(vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """`project`, written below `folder` under the vectors' fingerprint and read from there the next time.

    A map is found only if it was written whole; other vectors, or other settings (`how`), have another name.
    """
    spark = vectors.sparkSession
    mark = embeddings.fingerprint(vectors, key, vector).first()["fingerprint"]
    path = f"{folder.rstrip('/')}/{'-'.join([mark, *[f'{k}={v}' for k, v in sorted(how.items())]])}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        project(vectors, key, vector, **how).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def neighbours_kept(vectors: DataFrame, placed: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = 4_096) -> DataFrame:
    """One row (share): how many of each vector's k nearest others are among its k nearest on the map, on average."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    flat = placed.select(F.col(key).alias("k"), F.array("x", "y").alias("v"))
    of = lambda t, name: cells.neighbours(t, None, k, block).lists.select("k", F.transform("near", lambda n: n["o"]).alias(name))
    both = of(rows, "a").join(of(flat, "b"), "k")
    return both.agg(F.avg(F.size(F.array_intersect("a", "b")) / F.size("a")).alias("share"))
