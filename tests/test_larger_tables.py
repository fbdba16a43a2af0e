"""Steps whose work must not outgrow the input: neighbours, image headers, masks, matched boxes, chosen rows."""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievework.functions import masks
from sievework.functions.images import header
from sievework.operators import cells, evaluate, selection
from sievework.sources import png_masks


def test_neighbours_of_unclustered_vectors_meet_in_few_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) + 1000  # far from the origin, so single precision alone would mix up neighbours
    x[700:720] = x[700]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    found = cells.neighbours(rows, None, 5, 4)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    got = {r.k: [n.d for n in r.near] for r in found.lists.collect()}
    assert np.allclose(np.array([got[i] for i in range(len(x))]), np.sort(far, 1)[:, :5], atol=1e-9)
    assert found.pairs <= (2 * cells.SIDE + 1) ** 2  # 375 blocks a side before


def test_class_runs_of_a_png_mask_in_one_pass():
    rng = np.random.default_rng(0)
    for size in (0, 1, 7, 500):
        flat = rng.integers(0, 4, size).astype(np.uint8)
        assert png_masks._class_runs(flat) == {int(c): png_masks._runs((flat == c).astype(np.int8)) for c in np.unique(flat)}


def test_masks_are_encoded_in_batches(spark):
    rng = np.random.default_rng(1)
    pixels = [None, [], [1], [0], *[rng.integers(0, 2, n).tolist() for n in (2, 9, 280, 3000)], [1] * 50]
    made = spark.createDataFrame(list(enumerate(pixels)), "i int, p array<int>").select("i", masks.encode(F.col("p")).alias("r"))
    assert {r.i: r.r for r in made.collect()} == {i: png_masks._runs(np.array(p)) if p else [] for i, p in enumerate(pixels)}
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()  # a lambda for each pixel before


def test_headers_behind_many_segments_and_entries(spark):
    late = b"\xff\xd8" + b"\xff\xe1\x00\x04ab" * 500 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40) + bytes(12)  # null before: 400 segments at most
    far = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + bytes(65533)) * 3 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 5, 6) + bytes(12)
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in [(1, 0)] * 600 + [(256, 70), (257, 80)])
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 602) + entries  # null before: 512 entries at most
    rows = [(i, bytearray(c)) for i, c in enumerate((late, far, tiff, late[:-30], far[:150_000]))]
    got = {r.i: r.h and tuple(r.h) for r in spark.createDataFrame(rows, "i int, c binary").select("i", header(F.col("c")).alias("h")).collect()}
    assert got == {0: ("jpeg", 40, 30), 1: ("jpeg", 6, 5), 2: ("tiff", 70, 80), 3: None, 4: None}


def test_polygons_of_many_masks_are_filled_together(spark):
    def fill(polygons):  # by each pixel's centre
        bits = np.zeros((9, 12), np.int8)
        for p in polygons:
            corners = list(zip(p[0::2], p[1::2], strict=True))
            for row in range(9):
                cross = [xa + (row + 0.5 - ya) * (xb - xa) / (yb - ya) for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1], strict=True) if (ya <= row + 0.5) != (yb <= row + 0.5)]
                bits[row] |= np.array([sum(c <= col + 0.5 for c in cross) % 2 for col in range(12)], np.int8)
        return png_masks._runs(bits.ravel())

    rng = np.random.default_rng(2)
    lists = [[rng.uniform(-3, 15, 2 * n).tolist() for n in rng.integers(3, 8, k)] for k in (0, 1, 2, 5, 1, 3)]
    made = masks._filled(pa.array([*lists, [None, [1.0, 2.0]]], pa.list_(pa.list_(pa.float64()))), 12, 9)  # one mask at a time before
    assert made.to_pylist() == [*map(fill, lists), [108]]


def test_boxes_of_groups_across_batches_are_matched(spark):
    x = (F.col("id") * 7) % 5
    boxes = spark.range(120).select((F.col("id") % 11).cast("double").alias("sample"), (F.col("id") % 2).cast("string").alias("label"), "id", x.alias("x"), F.lit(0).alias("y"), F.lit(9).alias("width"), F.lit(9).alias("height"), ((F.col("id") * 13) % 10 / 10).alias("confidence"))
    boxes = boxes.withColumn("sample", F.when(F.col("sample") == 4, float("nan")).otherwise(F.col("sample")))
    shifted = boxes.withColumn("x", F.col("x") + 2)
    pairs = evaluate.match_boxes(boxes.drop("confidence"), shifted)
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()  # a lambda for each pair of boxes before
    whole = sorted(map(str, pairs.collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert sorted(map(str, evaluate.match_boxes(boxes.drop("confidence"), shifted).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum("gt_id=None" not in r for r in whole) == sum("pred_id=None" not in r for r in whole) == 120


def test_metric_names_are_distinct_before_they_meet_the_runs(spark):
    runs = spark.createDataFrame([(0, "a", "b"), (1, "a", "c")], "run long, truth string, predicted string")
    made = evaluate.metric_names(runs, spark.range(1000).select((F.col("id") % 3).alias("run"), F.when(F.col("id") % 5 > 0, "iou").alias("metric")), "b")
    assert [tuple(r) for r in made.collect()] == [(0, "iou")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # all pairs met the runs, and a run's in one task, before


def test_first_rows_are_merged_before_they_reach_the_driver(spark):
    rows = spark.range(1000, numPartitions=20).select("id", (F.col("id") % 7).alias("__x"))
    assert [r["id"] for r in selection._first(rows, "id", 9)] == [6 + 7 * i for i in range(9)]  # each partition sent its own before
