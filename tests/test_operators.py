"""Hand-checked values of the operators that SQL does not check."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sievework.functions import metadata as M
from sievework.functions import vectors as V
from sievework.operators import catalog, embeddings, evaluate, facets, ordering, selection
from sievework.sources import readers, writers
from sievework.streaming.ingest import ingest_new


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_similarity_and_typicality(spark):
    keys = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [v for _, v in rows(embeddings.similarity_to(keys, keys.where("vec_id in (0, 2)")), "vec_id", "similarity")]
    assert got == pytest.approx([1, 0.7678481, 1, 0.023853203], rel=1e-6)
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [v for _, v in rows(embeddings.typicality(few), "vec_id", "typicality")] == pytest.approx([0.3225063, 0.4222289, 0.3853082], rel=1e-6)
    assert [v for _, v in rows(embeddings.typicality(few, block=1), "vec_id", "typicality")] == pytest.approx([0.3225063, 0.4222289, 0.3853082], rel=1e-6)


def test_polygons(spark):
    points = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0), (9.9, 9.9), (5.0, 20.0)], "x double, y double")
    inside = V.inside_polygon(F.col("x"), F.col("y"), [(0, 0), (10, 0), (10, 10), (0, 10)])
    assert [r[0] for r in points.select(inside).collect()] == [True, False, False, True, False]
    hollow = spark.createDataFrame([(5.0, 8.0), (5.0, 2.0), (1.0, 1.0)], "x double, y double")
    inside = V.inside_polygon(F.col("x"), F.col("y"), [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)])
    assert [r[0] for r in hollow.select(inside).collect()] == [False, True, True]


def test_iou(spark):
    box = "struct<x:int,y:int,width:int,height:int>"
    df = spark.createDataFrame([((0, 0, 10, 10), (5, 0, 10, 10)), ((-3, -1, 23, 21), (0, 0, 10, 10)), ((1, 1, 0, 0), (1, 1, 0, 0))], f"a {box}, b {box}")
    assert [r[0] for r in df.select(V.box_iou(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 100 / 483, 0])


def test_greedy_ties(spark):
    gt = spark.createDataFrame([(1, 10, "a", 0, 0, 10, 10)], "sample long, id long, label string, x int, y int, width int, height int")
    pred = spark.createDataFrame([(1, 1, "a", 0, 0, 10, 10, 0.8), (1, 2, "a", 0, 0, 10, 10, 0.8), (2, 3, "a", 0, 0, 5, 5, None)], "sample long, id long, label string, x int, y int, width int, height int, confidence double")
    pairs = evaluate.match_boxes(gt, pred)
    assert sorted(map(tuple, pairs.collect()), key=str) == [(1, 10, 1, 1.0), (1, None, 2, None), (2, None, 3, None)]
    assert rows(evaluate.sample_counts(pairs), "sample", "tp", "fp", "fn") == [(1, 1, 1, 0), (2, 0, 1, 0)]


def test_mask_iou(spark):
    schema = "sample long, label string, rle array<int>"
    gt = spark.createDataFrame([(1, "A", [0, 2, 2])], schema)
    pred = spark.createDataFrame([(1, "A", [0, 2, 2]), (1, "B", [2, 2])], schema)
    assert rows(evaluate.mask_iou(gt, pred), "sample", "miou") == [(1, 0.5)]


def test_selection(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [5.0])], "id long, v array<double>")
    assert [r["id"] for r in selection.diverse(v, 2, "id", "v").orderBy("step").collect()] == [0, 2]
    grid = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(20)], "id long, v array<double>")
    kept = [r["id"] for r in selection.diverse(grid, 10, "id", "v", least=5.0).collect()]
    assert 2 <= len(kept) <= 9 and all(abs(a - b) * math.sqrt(2) >= 5 for a in kept for b in kept if a != b)
    w = spark.createDataFrame([(0, 1.0, 6.0), (1, 2.0, 5.0), (2, 3.0, 3.0)], "id long, a double, b double")
    assert [r["id"] for r in selection.weighted(w, 2, [("a", 1.0)], "id").collect()] == [2, 1]
    assert [r["id"] for r in selection.weighted(w, 2, [("a", 1.0), ("b", 1.0)], "id").collect()] == [1, 2]
    s = spark.createDataFrame([(0, ["cat", "dog"]), (1, ["dog"]), (2, ["dog", "bird"])], "id long, labels array<string>")
    third = {"cat": 1 / 3, "dog": 1 / 3, "bird": 1 / 3}
    assert sorted(r["id"] for r in selection.balanced(s, 2, "id", third).collect()) == [0, 2]


def test_metadata(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2, 3]}, "x.y": true, "s": "10"}'), (2, '{"s": "9"}'), (3, None)], "id long, data string")
    at = lambda p: [r[0] for r in df.orderBy("id").select(M.at_path(F.col("data"), p)).collect()]
    assert at("a.b[0]") == ["1", None, None] and at("a.b[-1]") == ["3", None, None] and at("a.b[-4]") == [None] * 3
    assert [r["id"] for r in df.where(M.is_in(F.col("data"), "x.y", [True])).collect()] == [1]
    assert [r["id"] for r in df.where(M.is_in(F.col("data"), "x.y", [False, None])).orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in df.orderBy(*M.sort_keys(F.col("data"), "s")).collect()] == [2, 1, 3]
    new = spark.createDataFrame([(2, '{"s": "7", "t": "1"}'), (4, '{"u": "1"}')], "id long, data string")
    merged = {r["id"]: json.loads(r["data"]) for r in M.upsert(df, new, "id", "data").collect()}
    assert merged[2] == {"s": "7", "t": "1"} and merged[4] == {"u": "1"} and merged[3] == {}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [tuple(r) for r in facets.histogram(df, F.col("v")).collect()] == [(0, 2, 5.0, 5.0)]
    assert facets.histogram(df.limit(0), F.col("v")).count() == 0


def test_order_and_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id long, v int")
    for down, want in ((False, [3, 2, 1]), (True, [2, 3, 1])):
        assert [r["id"] for r in ordering.page(df, [("v", down)], "id", 0, 9).collect()] == want
    assert ordering.page(df, [("v", False)], "id", 2, 1).count() == 0
    frames = spark.createDataFrame([(v, i) for v, n in ((1, 3), (2, 4)) for i in range(n)], "video long, frame int")
    assert ordering.chunks(frames, "video", "frame", 2).select("video", "chunk").distinct().count() == 3


def test_catalog(spark):
    a = spark.createDataFrame([("x", 1)], "old string, n int")
    ids = catalog.new_ids(a, "old", "c")
    assert catalog.remap(a, ids, "old").first()["old"] == ids.first()["new"]
    with pytest.raises(Exception, match="without a copy"):
        catalog.remap(spark.createDataFrame([("y",)], "old string"), ids, "old").collect()
    with pytest.raises(ValueError):
        catalog.delete_labels(a, "old", [])


def test_readers_and_writers(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}], "categories": [{"id": 3, "name": "cat"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [1.9, 2, 3, 4.5], "caption": "  hi "}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in readers.read_detections(spark, str(tmp_path / "d.json")).collect()] == [("a.jpg", 7, "cat", 1, 2, 3, 4)]
    assert [tuple(r) for r in readers.read_captions(spark, str(tmp_path / "d.json")).collect()] == [("a.jpg", "hi")]
    (tmp_path / "e.json").write_text(json.dumps({"database": {"v1": {"annotations": [{"label": "run", "segment": [1.0, 2.5]}, {"label": "bad", "segment": [3.0, 1.0]}]}}}))
    assert [tuple(r) for r in readers.read_events(spark, str(tmp_path / "e.json")).collect()] == [("v1", "run", 1.0, 2.5)]
    tracks = {"videos": [{"id": 1, "file_names": ["v/0.jpg"]}], "categories": [{"id": 1, "name": "dog"}], "annotations": [{"id": 5, "video_id": 1, "category_id": 1, "bboxes": [[1, 2, 3, 4], None]}]}
    (tmp_path / "t.json").write_text(json.dumps(tracks))
    assert [tuple(r) for r in readers.read_tracks(spark, str(tmp_path / "t.json")).collect()] == [("v/0.jpg", 5, "dog", 0, 1, 2, 3, 4)]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "img.txt").write_text("1 0.5 0.5 0.2 0.4\n")
    sizes = spark.createDataFrame([("img", 100, 50)], "stem string, width int, height int")
    assert [tuple(r) for r in readers.read_label_lines(spark, str(tmp_path / "y"), ["a", "b"], sizes).collect()] == [("img", "b", 40, 15, 20, 20)]
    images = spark.createDataFrame([(1, "/b.jpg", 10, 10), (2, "/a.jpg", 10, 10)], "sample long, file_path_abs string, width int, height int")
    boxes = spark.createDataFrame([(1, "cat", 1, 1, 2, 2)], "sample long, label string, x int, y int, width int, height int")
    got = writers.detection_tables(images, boxes, boxes.select("label"))
    assert sorted(map(tuple, got[0].select("id", "file_name").collect())) == [(0, "/a.jpg"), (1, "/b.jpg")]
    assert [tuple(r) for r in got[2].collect()] == [(1, 0, [1, 1, 2, 2])]


def test_ingest_twice(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "path string, n int").write.parquet(src)
    ingest_new(spark, src, "path string, n int", out, mark)
    spark.createDataFrame([("b", 2), ("c", 3)], "path string, n int").write.mode("append").parquet(src)
    ingest_new(spark, src, "path string, n int", out, mark)
    assert rows(spark.read.parquet(out), "path") == [("a",), ("b",), ("c",)]
