"""Search and scores on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import cosine, norm
from sievework.operators.cells import neighbours


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k nearest by cosine, ties by key; vectors without length are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, cosine(F.col(vector), q).alias("similarity")).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def _blocks(frame: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(frame[vector].to_numpy()).astype(np.float64)


def _meet(rows: DataFrame, queries: DataFrame, key: str, vector: str, block: int, pair, schema: str) -> DataFrame:
    """What `pair` makes of every block of rows with every block of queries: the queries are a stated set, so this is a search, not a join of all pairs.

    Blocks are dealt by a hash of the key; a block of queries goes to each block of rows in one shuffle.
    """
    parts = [max(1, -(-t.count() // block)) for t in (rows, queries)]
    named = lambda t, n, own, other, m: t.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    left, right = named(rows, parts[0], "b", "o", parts[1]), named(queries, parts[1], "o", "b", parts[0])

    def run(_, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({c.strip().split(" ")[0]: [] for c in schema.split(",")}).astype({"k": a["k"].dtype})
        return pair(a["k"].to_numpy(), _blocks(a, "v"), b["k"].to_numpy(), _blocks(b, "v"))

    return left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(run, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4_096) -> DataFrame:
    """(query_id, key, similarity) of the k nearest of every query by cosine, ties by key; vectors without length are left out.

    Exact: vectors are brought to unit length, so their distances order as their cosines, and blocks of
    queries meet the cells that can hold one of their k nearest (see `cells.neighbours`). Null keys and
    vectors are left out; a similarity counts to nine decimals.
    """
    def unit(rows: DataFrame) -> DataFrame:
        held = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
        length = norm(F.col("v"))
        return held.where(length > 0).select("k", F.transform("v", lambda x: x.cast("double") / length).alias("v"))

    lists = neighbours(unit(vectors), unit(queries), k, block, cosine=True).lists.select("k", F.explode("near").alias("n"))
    return lists.select(F.col("k").alias("query_id"), F.col("n.o").alias(key), F.round(1 - F.col("n.d"), 9).alias("similarity"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, block: int = 4_096) -> DataFrame:
    """(k, d): the Euclidean distance of each vector to the nearest of the queries; without queries no row."""
    kind = vectors.schema[key].dataType.simpleString()

    def pair(ka, x, kb, q):
        best = np.full(len(x), np.inf)
        for row in q:
            best = np.minimum(best, np.sqrt(((x - row) ** 2).sum(axis=1)))
        return pd.DataFrame({"k": ka, "d": best})

    return _meet(vectors, queries, key, vector, block, pair, f"k {kind}, d double").groupBy("k").agg(F.min("d").alias("d"))


def similarity_to(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 4_096) -> DataFrame:
    """(key, similarity): exp(-d / mean d) of each vector's Euclidean distance d to the nearest query.

    `queries` (with the vector's column) is the stated query set, of tagged examples; where all distances
    are zero the similarity is 1; without queries it fails. Each block of queries gives its nearest.
    """
    if queries.limit(1).isEmpty():
        raise ValueError("no query vectors")
    near = nearest(vectors, queries, key, vector, block)
    mean = near.agg(F.avg("d").alias("m"))
    score = F.when(F.col("m") > 0, F.exp(-F.col("d") / F.col("m"))).otherwise(1.0)
    return near.join(F.broadcast(mean)).select(F.col("k").alias(key), score.alias("similarity"))  # mean: one row


def typicality(vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = 4_096) -> DataFrame:
    """(key, typicality): mean of exp(-d / D) over the k nearest others, D the mean of all those distances.

    Exact: a block of vectors meets only the cells around pivots that can hold a nearer one, see
    `cells.neighbours`. Keys of any type that has an order; null keys and vectors are left out, a single vector has no typicality.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    lists = neighbours(rows, None, min(k, rows.count() - 1), block).lists.select("k", F.transform("near", lambda n: n["d"]).alias("d"))
    scale = lists.select(F.explode("d").alias("d")).agg(F.avg("d").alias("m"))
    weight = F.transform("d", lambda x: F.when(F.col("m") > 0, F.exp(-x / F.col("m"))).otherwise(1.0))
    mean = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x) / F.size("d")
    return lists.join(F.broadcast(scale)).select(F.col("k").alias(key), mean.alias("typicality"))  # scale: one row


def project(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x, y): the first two principal components; one vector lies at (0, 0), two at (0, 0) and (1, 1) by key."""
    few = [r[0] for r in vectors.select(key).orderBy(key).limit(3).collect()]
    if len(few) < 3:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([(k, float(i), float(i)) for i, k in enumerate(few)], f"{key} {kind}, x double, y double")
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    made = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return made.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def fingerprint(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """One row (n, fingerprint) that changes with any key or vector, whatever the order of rows.

    Each row's MD5 gives a number; their count, sum and exclusive or make the fingerprint, so it is one
    aggregation with partial results. Elements count to `digits` decimals.
    """
    text = F.concat_ws("|", F.col(key).cast("string"), F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 10**digits).cast("long").cast("string")), ","))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    held = vectors.select(number.alias("m")).agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("m"), F.lit(0)).alias("x"))
    return held.select("n", F.concat_ws("-", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")).alias("fingerprint"))


def missing(annotations: DataFrame, images: DataFrame, embedded: DataFrame, kinds: tuple = ("object_detection", "segmentation_mask")) -> DataFrame:
    """(id, path) of annotations with a box but without an embedding, in the order of their images' paths.

    annotations: id, sample, kind; images: sample, path; embedded: id.
    """
    left = annotations.where(F.col("kind").isin(*kinds)).join(embedded.select("id"), "id", "left_anti")
    return left.join(images.select("sample", "path"), "sample").select("id", "path").orderBy("path", "id")


def crop_boxes(boxes: DataFrame) -> DataFrame:
    """`boxes` (x, y, width, height, image_width, image_height) cut to their images; boxes without a pixel inside are left out."""
    x0, y0 = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    x1, y1 = F.least(F.col("x") + F.col("width"), F.col("image_width")), F.least(F.col("y") + F.col("height"), F.col("image_height"))
    cut = boxes.withColumns({"__x": x0, "__y": y0, "__w": x1 - x0, "__h": y1 - y0}).where("__w > 0 AND __h > 0")
    return cut.withColumns({"x": F.col("__x"), "y": F.col("__y"), "width": F.col("__w"), "height": F.col("__h")}).drop("__x", "__y", "__w", "__h")


def embed_with(rows: DataFrame, model, dimensions: int, column: str, key: str) -> DataFrame:
    """(key, embedding) by a model, a function from a list of values to as many vectors, run per Arrow batch.

    It fails where the model gives another number of vectors or another length. A model gives None for
    a value that it cannot read: that row is left out (`unread` names it).
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = list(model(b["v"].tolist())) if len(b) else []
            if len(found) != len(b):
                raise ValueError(f"the model gave {len(found)} vectors, not {len(b)}")
            read = [v is not None for v in found]
            made = np.array([v for v in found if v is not None], np.float32).reshape(sum(read), -1) if any(read) else np.empty((0, dimensions), np.float32)
            if made.shape[1] != dimensions:
                raise ValueError(f"the model gave {made.shape}, not {(len(b), dimensions)}")
            yield pd.DataFrame({"k": b["k"][read].to_numpy(), "e": pd.Series(made.tolist(), dtype=object)})

    made = rows.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInPandas(run, f"k {kind}, e array<float>")
    return made.select(F.col("k").alias(key), F.col("e").alias("embedding"))


def unread(rows: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """(key) of the rows that got no embedding."""
    return rows.select(key).join(embedded.select(key), key, "left_anti")


class Models:
    """Embedding models by name, each with its dimensions; the first one is the default."""

    def __init__(self):
        self._held: dict = {}

    def register(self, name: str, model, dimensions: int) -> None:
        if name in self._held:
            raise ValueError(f"there is a model named {name} already")
        self._held[name] = (model, dimensions)

    def embed(self, rows: DataFrame, column: str, key: str, name: str | None = None) -> DataFrame:
        if not self._held or (name is not None and name not in self._held):
            raise ValueError(f"no model named {name}" if self._held else "no model is registered")
        model, dimensions = self._held[name if name is not None else next(iter(self._held))]
        return embed_with(rows, model, dimensions, column, key)


def hashed_model(dimensions: int):
    """A model for tests: unit vectors from a hash of each value, equal for equal values on every machine."""
    import hashlib

    def model(values: list) -> list:
        out = []
        for v in values:
            seed = int.from_bytes(hashlib.sha256(repr(v).encode()).digest()[:8], "big")
            x = np.random.default_rng(seed).normal(size=dimensions)
            out.append(x / np.linalg.norm(x))
        return out

    return model
