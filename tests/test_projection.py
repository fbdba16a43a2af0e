"""The neighbour-keeping map against principal components, and the maps that are kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import embeddings, projection


@pytest.fixture(scope="module")
def vectors(spark):
    """A curve that winds through 16 dimensions."""
    t = np.random.default_rng(4).permutation(300) / 300
    x = np.concatenate([f(2 * np.pi * k * t)[:, None] for k in (1, 2, 3, 4, 5, 6, 7, 8) for f in (np.sin, np.cos)], axis=1)
    return spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "k string, e array<double>").cache()


@pytest.mark.parametrize("block", [100, 4096])
def test_neighbours_stay_together(spark, vectors, block):
    placed = projection.project(vectors, "k", "e", block=block, rounds=8, steps=40)
    assert placed.count() == 300 and placed.select("k").distinct().count() == 300
    kept = lambda p: projection.neighbours_kept(vectors, p, 10, "k", "e").first().share
    assert kept(placed) > 0.6 > kept(embeddings.project(vectors, "k", "e"))


def test_maps_are_kept(spark, vectors, tmp_path, monkeypatch):
    few = vectors.where("k < 'v030'")
    first = {r.k: (r.x, r.y) for r in projection.kept_projection(few, str(tmp_path), "k", "e", rounds=2).collect()}
    monkeypatch.setattr(projection, "project", None)  # the second call must not come to it
    assert {r.k: (r.x, r.y) for r in projection.kept_projection(few.repartition(5), str(tmp_path), "k", "e", rounds=2).collect()} == first
    with pytest.raises(TypeError):
        projection.kept_projection(few.where("k < 'v020'"), str(tmp_path), "k", "e")


def test_small_maps(spark, vectors):
    holes = vectors.limit(2).unionByName(spark.createDataFrame([(None, [1.0]), ("n", None)], "k string, e array<double>"))
    assert {(r.x, r.y) for r in projection.project(holes, "k", "e").collect()} == {(0.0, 0.0), (1.0, 1.0)}
    assert projection.project(vectors.limit(0), "k", "e").count() == 0
    assert projection.project(vectors.limit(5).withColumn("e", F.array(F.lit(1.0), F.lit(2.0))), "k", "e", rounds=1).count() == 5
