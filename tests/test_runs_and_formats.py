"""Evaluation runs and what is kept of them, collections, tracks, events, configurations, forests and models."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import catalog, embeddings, fewshot, runs
from sievework.sources import readers


@pytest.fixture(scope="module")
def tables(spark):
    ann = "sample int, id int, source string, kind string, label string, x int, y int, width int, height int, confidence double, rle array<bigint>"
    box, mask = "object_detection", "segmentation_mask"
    rows = [
        (1, 10, "gt", box, "cat", 0, 0, 10, 10, None, None), (1, 11, "gt", box, "dog", 50, 50, 10, 10, None, None), (1, 20, "p", box, "cat", 0, 0, 10, 10, 0.9, None), (1, 21, "p", box, "cat", 0, 1, 10, 10, 0.8, None), (3, 12, "gt", box, "cat", 0, 0, 1, 1, None, None),
        (1, 30, "cg", "classification", "cat", None, None, None, None, None, None), (1, 31, "cp", "classification", "cat", None, None, None, None, 0.75, None), (2, 32, "cg", "classification", "cat", None, None, None, None, None, None), (2, 33, "cp", "classification", "dog", None, None, None, None, 0.5, None),
        (1, 40, "mg", mask, "cat", 0, 0, 2, 2, None, [0, 2, 2]), (1, 41, "mp", mask, "cat", 0, 0, 2, 2, None, [1, 3]),
    ]
    cover = [(s, i) for s in ("gt", "p", "cg", "cp") for i in (1, 2)] + [("gt", 3), ("mg", 1), ("mp", 1)]
    return spark.createDataFrame([(1,), (2,), (3,)], "sample int"), spark.createDataFrame(rows, ann), spark.createDataFrame(cover, "source string, sample int")


NONE = "dataset string, name string, truth string, predicted string, task string, config string"


def test_runs_of_all_tasks_are_kept(spark, tables, tmp_path):
    samples, annotations, coverage = tables
    of = lambda task, name, a, b, known, **c: runs.evaluate_run(task, name, "d", a, b, samples, annotations, coverage, known, **c)
    known, folder = spark.createDataFrame([], NONE), str(tmp_path / "eval")
    runs.keep(of("object_detection", "boxes", "gt", "p", known), folder)
    runs.keep(of("classification", "classes", "cg", "cp", runs.kept(spark, folder).runs), folder)
    runs.keep(of("semantic_segmentation", "masks", "mg", "mp", runs.kept(spark, folder).runs), folder)
    (tmp_path / "eval" / "sample_metrics" / "dataset=d" / "run=lost").mkdir()
    held = runs.kept(spark, folder)
    assert {(r["name"], r.task) for r in held.runs.collect()} == {("boxes", "object_detection"), ("classes", "classification"), ("masks", "semantic_segmentation")}
    metrics = {(r.run, r["sample"], r.metric): round(r.value, 6) for r in held.sample_metrics.collect()}
    boxes = {("boxes", 1, "tp"): 1.0, ("boxes", 1, "fp"): 1.0, ("boxes", 1, "fn"): 1.0, ("boxes", 2, "tp"): 0.0, ("boxes", 2, "fp"): 0.0, ("boxes", 2, "fn"): 0.0}
    assert metrics == boxes | {("classes", 1, "disagreement"): 0.25, ("classes", 2, "disagreement"): 0.5, ("masks", 1, "miou"): 0.25}
    pairs = {(r.run, r.gt_id, r.pred_id, r.metric) for r in held.pair_metrics.collect()}
    assert pairs == {("boxes", 10, 20, "iou"), ("boxes", None, 21, None), ("boxes", 11, None, None), ("classes", 30, 31, "disagreement"), ("classes", 32, 33, "disagreement")}
    with pytest.raises(ValueError, match="named boxes already"):
        of("object_detection", "boxes", "gt", "p", held.runs)
    for bad in (lambda: of("instance_segmentation", "x", "gt", "p", known), lambda: of("classification", "x", "gt", "p", known), lambda: of("classification", "x", "cg", "cp", known, threshold=0.5)):
        with pytest.raises(ValueError):
            bad()


def test_collections(spark):
    nodes = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (4, None, "other")], "key int, parent int, name string")
    more = catalog.create_collection(nodes, (5, 1, "b"))
    assert more.count() == 5
    for row in ((6, 1, "a"), (6, None, "other"), (6, 99, "x")):
        with pytest.raises(ValueError):
            catalog.create_collection(nodes, row)
    assert {r.name for r in catalog.rename_collection(more, 5, "c").where("parent = 1").collect()} == {"a", "c"}
    for name in ("a", " "):
        with pytest.raises(ValueError):
            catalog.rename_collection(more, 5, name)
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(60)] + [(100, None, "x")], "key int, parent int, name string")
    assert {r.key for r in catalog.below(chain, [50, 100]).collect()} == {*range(50, 60), 100}
    left, samples = catalog.delete_collections(chain, chain.select(F.col("key").alias("collection"), "name"), [1])
    assert {r.key for r in left.collect()} == {0, 100} == {r.collection for r in samples.collect()}


def test_tracks_meet_videos(spark, tmp_path):
    doc = {"videos": [{"id": 1, "file_names": ["a", "a", "a"]}, {"id": 2, "file_names": ["b.mp4"]}, {"id": 3, "file_names": ["gone"]}], "categories": [{"id": 1, "name": "cat"}], "annotations": [{"id": 7, "video_id": 1, "category_id": 1, "bboxes": [[1, 2, 3, 4], None, [5, 6, 7, 8]]}, {"id": 8, "video_id": 2, "category_id": 1, "bboxes": [[0, 0, 1, 1]]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    of = lambda *v: readers.attach_tracks_to_videos(spark, str(tmp_path / "t.json"), "/v", spark.createDataFrame(v, "video int, path string, n_frames int"))
    found, missing = of((1, "/v/a.mov", 3), (2, "/v/b.mp4", 1))
    assert sorted((r.video, r.track, r.frame, r.x) for r in found.collect()) == [(1, 7, 0, 1), (1, 7, 2, 5), (2, 8, 0, 0)] and [r.file_name for r in missing.collect()] == ["gone"]
    with pytest.raises(Exception, match="another number of frames: a"):
        of((1, "/v/a.mov", 4))[0].collect()
    with pytest.raises(Exception, match="several videos are called /v/a"):
        of((1, "/v/a.mov", 3), (2, "/v/a.mp4", 3))[0].collect()


def test_events_meet_videos(spark, tmp_path):
    doc = lambda *s: json.dumps({"database": {"one": {"annotations": [{"label": "run", "segment": list(s)}]}, "two": {"annotations": [{"label": "sit", "segment": [0, 1]}]}}})
    (tmp_path / "e.json").write_text(doc(1.5, 2.5))
    events = readers.read_events(spark, str(tmp_path / "e.json"))
    found, missing = readers.attach_events(events, spark.createDataFrame([(9, "/v/one.mp4"), (8, "/v/three.mp4")], "video int, path string"))
    assert [(r.video, r.label, r.start_s) for r in found.collect()] == [(9, "run", 1.5)] and [r.stem for r in missing.collect()] == ["two"]
    with pytest.raises(Exception, match="several videos are called one"):
        readers.attach_events(events, spark.createDataFrame([(9, "/v/one.mp4"), (8, "/w/one.mov")], "video int, path string"))[0].collect()
    (tmp_path / "e.json").write_text(doc(2.5, 2.5))
    with pytest.raises(Exception, match="does not begin before it ends: one"):
        readers.read_events(spark, str(tmp_path / "e.json"), strict=True).collect()
    assert [r.stem for r in readers.read_events(spark, str(tmp_path / "e.json")).collect()] == ["two"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("names: {0: cat, 1: 'big, dog'}  # two\ntrain: images/train # here\n", ["cat", "big, dog"]),
        ("# all\nnames: [cat, \"dog # no\"] # two\ntrain: 'images/train'\n", ["cat", "dog # no"]),
        ("train: images/train\nnames:\n  # the first\n  0: cat # a\n  1: dog\n", ["cat", "dog"]),
        ("train: images/train\nnames:\n- cat\n- dog\n", ["cat", "dog"]),
    ],
)
def test_configurations(spark, tmp_path, text, names):
    (tmp_path / "data.yaml").write_text(text)
    assert readers.read_splits(spark, str(tmp_path / "data.yaml")) == (names, {"train": "images/train"})
    (tmp_path / "bad.yaml").write_text("train: x\n")
    with pytest.raises(ValueError):
        readers.read_splits(spark, str(tmp_path / "bad.yaml"))


def test_native_detections(spark, tmp_path):
    (tmp_path / "predictions" / "sub").mkdir(parents=True)
    (tmp_path / "schema.json").write_text(json.dumps({"task_name": "t", "categories": [{"id": 0, "name": "cat"}, {"id": 1, "name": "dog"}]}))
    for name, own in (("a.jpg", [{"category_id": 1, "bbox": [1.9, 2, 3, 4], "score": 0.5}]), ("sub/b.jpg", []), ("sub/c.jpg", [{"category_id": 0, "bbox": [0, 0, 1, 1]}])):
        (tmp_path / "predictions" / f"{name}.json").write_text(json.dumps({"file_name": name, "predictions": own}))
    got = {(r.file_name, r.label, r.x, r.y, r.width, r.height, r.confidence) for r in readers.read_native(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", "dog", 1, 2, 3, 4, 0.5), ("sub/c.jpg", "cat", 0, 0, 1, 1, None)}


def test_forests_are_saved_whole(spark, tmp_path):
    trees = [{"classes": ["a", "b"], "trained": ["a", "b"], "nodes": [{"feature": 0, "threshold": 0.5, "left": 1, "right": 2}, {"shares": [1.0, 0.0]}, {"shares": [0.25, 0.75]}]}]
    path = str(tmp_path / "forest.json")
    fewshot.save_portable(trees, spark, path)
    assert fewshot.load_portable(spark, path) == trees
    with pytest.raises(Exception):
        fewshot.save_portable(trees, spark, path)
    held = json.loads((tmp_path / "forest.json").read_text())
    for i, change in enumerate(({"version": 2}, {"n_trees": 3}, {"trees": [trees[0] | {"nodes": trees[0]["nodes"][:2]}]})):
        (tmp_path / f"bad{i}.json").write_text(json.dumps(held | change))
        with pytest.raises(ValueError):
            fewshot.load_portable(spark, str(tmp_path / f"bad{i}.json"))


def test_unread_values_get_no_vector(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "broken"), (3, "b")], "k int, v string")
    made = embeddings.embed_with(rows, lambda vs: [None if v == "broken" else [float(len(v)), 0.0] for v in vs], 2, "v", "k")
    assert {r.k for r in made.collect()} == {1, 3} and [r.k for r in embeddings.unread(rows, made, "k").collect()] == [2]
    defaults = catalog.put_default(spark.createDataFrame([("c", "m")], "collection string, space string"), "d", "n")
    assert {tuple(r) for r in defaults.collect()} == {("c", "m"), ("d", "n")}
    assert {tuple(r) for r in catalog.put_default(catalog.put_default(defaults, "c", "n"), "d", None).collect()} == {("c", "n")}
