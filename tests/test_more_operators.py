"""Hand-checked values of filters, views, selection, evaluation rules, masks, formats and few-shot classifiers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import masks
from sievework.functions import metadata as M
from sievework.operators import catalog, embeddings, evaluate, fewshot, filters, ordering, selection
from sievework.sources import readers, writers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_upsert_keeps_types(spark):
    old = spark.createDataFrame([(1, '{"k": 5, "o": {"b": 1}, "t": true, "f": 1.5, "s": "x"}'), (2, '{"k": 1}'), (3, None)], "id long, data string")
    new = spark.createDataFrame([(1, '{"k": 6, "q\\"q": [1, "a", null]}'), (4, '{"z": false}')], "id long, data string")
    made = {r["id"]: json.loads(r["data"]) for r in M.upsert(old, new, "id", "data").collect()}
    assert made == {1: {"k": 6, "o": {"b": 1}, "t": True, "f": 1.5, "s": "x", 'q"q': [1, "a", None]}, 2: {"k": 1}, 3: {}, 4: {"z": False}}
    assert rows(M.key_types(old, "data"), "key", "kind") == [("f", "float"), ("k", "integer"), ("o", "dict"), ("s", "string"), ("t", "boolean")]
    bad = spark.createDataFrame([(1, '{"k": "6", "f": 2, "t": 1}')], "id long, data string")
    assert rows(M.violations(old, bad, "data"), "key", "kind", "found") == [("k", "integer", "string"), ("t", "boolean", "integer")]
    assert [r[0] for r in old.orderBy("id").select(M.typed(F.col("data"), "f", "float")).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="k is no string"):
        old.select(M.typed(F.col("data"), "k", "string")).collect()


def test_disagreement_needs_one_of_each(spark):
    t = "sample long, label string, confidence double"
    gt, pred = [(1, "a", None), (2, "a", None)], [(1, "a", 0.25), (2, "b", None)]
    assert rows(evaluate.disagreement(spark.createDataFrame(gt, t), spark.createDataFrame(pred, t)), "sample", "disagreement") == [(1, 0.75), (2, 1.0)]
    for wrong_gt, wrong_pred in ((gt + [(1, "b", None)], pred), (gt, pred[:1]), (gt, pred + [(3, "a", 0.1)])):
        with pytest.raises(Exception, match="not one true and one predicted label"):
            evaluate.disagreement(spark.createDataFrame(wrong_gt, t), spark.createDataFrame(wrong_pred, t)).collect()


def test_run_rules_and_scope(spark):
    notes = spark.createDataFrame([("gt", "box"), ("pred", "box"), ("mixed", "box"), ("mixed", "mask")], "source string, kind string")
    runs = spark.createDataFrame([(1, "first")], "dataset long, name string")
    evaluate.check_run(notes, runs, "second", 1, "gt", "pred", "box")
    evaluate.check_run(notes, runs, "first", 2, "gt", "pred", "box")
    for name, a, b in (("first", "gt", "pred"), ("second", "gt", "gt"), ("second", "gt", "mixed"), ("second", "none", "pred")):
        with pytest.raises(ValueError):
            evaluate.check_run(notes, runs, name, 1, a, b, "box")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample long")
    cover = spark.createDataFrame([("gt", 1), ("gt", 2), ("pred", 2), ("pred", 3), ("gt", 3)], "source string, sample long")
    box = "sample long, id long, source string, label string, x int, y int, width int, height int, confidence double"
    boxes = spark.createDataFrame([(2, 1, "gt", "a", 0, 0, 10, 10, None), (2, 2, "pred", "a", 0, 0, 10, 10, 0.5), (1, 3, "gt", "a", 0, 0, 1, 1, None)], box)
    pairs, counts = evaluate.evaluate_boxes(samples, boxes, cover, "gt", "pred")
    assert rows(pairs, "gt_id", "pred_id", "gt_label", "pred_label", "iou") == [(1, 2, "a", "a", 1.0)]
    assert rows(counts, "sample", "tp", "fp", "fn") == [(2, 1, 0, 0), (3, 0, 0, 0)]
    assert tuple(evaluate.summary(samples, boxes, cover, "gt", "pred").first()) == (2, 1, 1)


def test_mask_rules(spark):
    schema = "sample long, label string, rle array<int>"
    a, b = spark.createDataFrame([(1, "A", [0, 4])], schema), spark.createDataFrame([(1, "A", [0, 5])], schema)
    with pytest.raises(Exception, match="different sizes"):
        evaluate.mask_iou(a, b).collect()
    samples = spark.createDataFrame([(1,), (2,)], "sample long")
    with pytest.raises(Exception, match="no mask on either side: sample 2"):
        evaluate.require_masks(samples, a, b).collect()


def test_masks(spark):
    cases = [([2, 3, 1, 2, 4], 4, 3), ([12], 4, 3), ([0, 12], 4, 3), ([3, 2, 7], 4, 3), ([11, 1], 4, 3)]
    df = spark.createDataFrame([(i, r, w, h) for i, (r, w, h) in enumerate(cases)], "id long, rle array<int>, w long, h long").withColumn("p", masks.decode(F.col("rle")))
    made = df.orderBy("id").select("p", masks.encode(F.col("p")).alias("again"), masks.area(F.col("rle")).alias("n"), masks.bounding_box(F.col("rle"), F.col("w")).alias("b"), masks.column_runs(F.col("rle"), F.col("w"), F.col("h")).alias("c")).collect()
    for r, (runs, w, h) in zip(made, cases, strict=True):
        bits = np.repeat(np.arange(len(runs)) % 2, runs).reshape(h, w)
        assert r["p"] == bits.ravel().tolist() and r["again"] == runs and r["n"] == bits.sum()
        ys, xs = np.nonzero(bits)
        assert tuple(r["b"]) == ((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1) if len(xs) else (0, 0, 0, 0))
        assert np.repeat(np.arange(len(r["c"])) % 2, r["c"]).tolist() == bits.T.ravel().tolist()


def test_greedy_choice_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    w = rng.random(300)
    df = spark.createDataFrame([(i, v.tolist(), float(a)) for i, (v, a) in enumerate(zip(x, w, strict=True))], "id long, v array<double>, w double")

    def plain(n, before=(), weights=None, least=None):
        far = np.full(300, np.inf)
        for b in before:
            far = np.minimum(far, np.linalg.norm(x - x[b], axis=1))
        static, scale, out = (0 if weights is None else weights * w / w.max()), None, []
        while len(out) < n:
            open_ = np.ones(300, bool)
            open_[[*before, *out]] = False
            if scale is None and np.isfinite(far).any():
                scale = far[open_].max()
            value = np.where(open_, static + np.where(np.isinf(far), 1.0, far) / (scale or 1.0), -np.inf)
            i = int(value.argmax())
            if least is not None and np.isfinite(far[i]) and far[i] < least:
                break
            out.append(i)
            far = np.minimum(far, np.linalg.norm(x - x[i], axis=1))
        return out

    got = lambda df: [r["id"] for r in df.orderBy("step").collect()]
    assert got(selection.diverse(df, 80, "id", "v")) == plain(80)
    assert got(selection.diverse(df, 300, "id", "v", least=2.0)) == plain(300, least=2.0)
    chosen = df.where("id in (3, 50)").select("id")
    assert got(selection.diverse(df, 40, "id", "v", chosen=chosen)) == plain(40, (3, 50))
    assert got(selection.diverse(df, 40, "id", "v", weights=[("w", 0.7)], chosen=chosen)) == plain(40, (3, 50), 0.7)
    assert len(got(selection.diverse(df.limit(5), 40, "id", "v"))) == 5
    with pytest.raises(ValueError):
        selection.diverse(df, 4, "id", "v", chosen=spark.createDataFrame([(999,)], "id long"))


def test_balance_modes_and_tags(spark):
    df = spark.createDataFrame([(i, ["a"] * (i % 3) + ["b"] * (i % 2) + ["c"] * (i % 5 == 0)) for i in range(60)], "id long, labels array<string>")
    got = [r["id"] for r in selection.balanced(df, 12, "id", "uniform").collect()]
    counts = {c: sum(x.count(c) for i, x in ((r["id"], r["labels"]) for r in df.collect()) if i in got) for c in "abc"}
    assert len(got) == len(set(got)) == 12 and max(counts.values()) - min(counts.values()) <= 1
    shares = selection.class_targets(df, "labels", "input")
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["c"]
    with pytest.raises(ValueError):
        selection.balanced(df, 3, "id", {"none": 1.0})
    with pytest.raises(ValueError):
        selection.weighted(df.withColumn("t", F.lit("x")), 2, [("t", 1.0)], "id")
    links = selection.tag_result(spark.createDataFrame([(1, "old")], "id long, tag string"), df.limit(2), "id", "new")
    assert links.count() == 3
    with pytest.raises(ValueError):
        selection.tag_result(links, df, "id", "new")


def test_sequences(spark):
    df = spark.createDataFrame([(v * 100 + i, v, i, [float(v * 10 + i // 2), 0.0]) for v in (1, 2) for i in range(7)], "id long, video long, frame long, v array<double>")
    got = rows(selection.sequences(df, 4, 2, "id", "video", "frame", "v"), "id", "step")
    assert got == [(100, 0), (101, 0), (204, 1), (205, 1)]
    later = selection.sequences(df, 2, 2, "id", "video", "frame", "v", df.where("video = 2 AND frame < 2").select("id"))
    assert rows(later, "id") == [(100,), (101,)]
    with pytest.raises(ValueError):
        selection.sequences(df, 5, 2, "id", "video", "frame", "v")


def test_filters(spark):
    notes = spark.createDataFrame([(1, 10, "box", "a", "cat"), (2, 10, "mask", "b", "dog"), (3, 20, "box", "b", "cat")], "id long, parent long, kind string, source string, label string")
    samples = spark.createDataFrame([(10, 5), (20, None), (30, 7)], "sample long, w int")
    links = spark.createDataFrame([(1, "t"), (3, "u")], "id long, tag string")
    F_ = filters.AnnotationsFilter
    assert rows(F_().apply(notes), "id") == [(1,), (2,), (3,)] and rows(F_(tags=["t", "x"], links=links).apply(notes), "id") == [(1,)]
    assert rows(F_().apply_to_parents(samples, notes, "sample"), "sample") == [(10,), (20,)]
    assert rows(F_(labels=["cat"], sources=["b"]).apply_to_parents(samples, notes, "sample"), "sample") == [(20,)]
    assert rows(F_(region=notes.limit(0).select("id")).apply(notes), "id") == []
    captions = spark.createDataFrame([(10,), (10,)], "sample long")
    for wanted, want in ((True, [(10,)]), (False, [(20,), (30,)]), (None, [(10,), (20,), (30,)])):
        assert rows(filters.SampleFilter(captioned=wanted, captions=captions).apply(samples, "sample"), "sample") == want
    assert rows(filters.SampleFilter(ranges={"w": (5, None)}).apply(samples, "sample"), "sample") == [(10,), (30,)]
    with pytest.raises(ValueError):
        filters.confusion_cell(notes, None, None)
    with pytest.raises(ValueError):
        filters.pair_samples(notes, "false_positive", prediction="a", criteria=[F.lit(True)])


def test_documents_that_readers_take(spark, tmp_path):
    images = spark.createDataFrame([(1, "/b.jpg", 10, 10), (2, "/a.jpg", 10, 10)], "sample long, file_path_abs string, width int, height int")
    boxes = spark.createDataFrame([(1, "cat", 1, 1, 2, 2), (2, "dog", 0, 0, 5, 5), (1, "dog", 3, 3, 1, 1)], "sample long, label string, x int, y int, width int, height int")
    writers.write_detections(images, boxes, boxes.select("label"), str(tmp_path / "d.json"))
    doc = json.loads((tmp_path / "d.json").read_text())
    assert [(i["id"], i["file_name"]) for i in doc["images"]] == [(0, "/a.jpg"), (1, "/b.jpg")] and [c["name"] for c in doc["categories"]] == ["cat", "dog"]
    assert sorted((a["image_id"], a["category_id"], a["bbox"]) for a in doc["annotations"]) == [(0, 1, [0, 0, 5, 5]), (1, 0, [1, 1, 2, 2]), (1, 1, [3, 3, 1, 1])]
    assert rows(readers.read_detections(spark, str(tmp_path / "d.json")), "file_name", "label", "x") == [("/a.jpg", "dog", 0), ("/b.jpg", "cat", 1), ("/b.jpg", "dog", 3)]
    masked = boxes.withColumn("rle", masks.box_runs(*[F.col(c).cast("long") for c in ("x", "y", "width", "height")], F.lit(10).cast("long"), F.lit(10).cast("long")))
    writers.write_detections(images, masked, boxes.select("label"), str(tmp_path / "m.json"))
    read = readers.read_masks(spark, str(tmp_path / "m.json")).where("label = 'dog' AND file_name = '/a.jpg'").first()
    assert (read["height"], read["width"], read["counts"]) == (10, 10, [0, 5, 5, 5, 5, 5, 5, 5, 5, 5, 55])
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "sample long, text string")
    writers.write_captions(images, texts, str(tmp_path / "c.json"))
    assert [(a["id"], a["image_id"], a["caption"]) for a in json.loads((tmp_path / "c.json").read_text())["annotations"]] == [(0, 0, "c"), (1, 1, "a"), (2, 1, "b")]
    writers.write_detections(images.limit(0), boxes.limit(0), boxes.limit(0).select("label"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"images": [], "categories": [], "annotations": []}


def test_label_files(spark, tmp_path):
    images = spark.createDataFrame([(1, "/x/b b.jpg", 10, 20), (2, "/a.jpg", 10, 10)], "sample long, file_path_abs string, width int, height int")
    boxes = spark.createDataFrame([(1, "cat", 1, 2, 2, 4), (2, "dog", 0, 0, 5, 5)], "sample long, label string, x int, y int, width int, height int")
    writers.write_label_lines(images, boxes, boxes.select("label"), str(tmp_path / "y"))
    assert (tmp_path / "y/labels/train/b b.txt").read_text().split() == ["0", "0.2", "0.2", "0.2", "0.2"]
    names, splits = readers.read_splits(spark, str(tmp_path / "y/data.yaml"))
    assert names == ["cat", "dog"] and splits == {"train": "images/train"}
    sizes = spark.createDataFrame([("b b", 10, 20), ("a", 10, 10)], "stem string, width int, height int")
    back = readers.read_label_splits(spark, str(tmp_path / "y"), names, sizes, ["train"], limit=1)
    assert rows(back, "stem", "label", "x", "tag") == [("a", "dog", 0, "train")]


def test_track_document(spark, tmp_path):
    videos = spark.createDataFrame([(7, "/v.mp4", 4, 4)], "video long, path string, width int, height int")
    frames = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 7, 30)], "frame long, video long, number int")
    objects = spark.createDataFrame([(2, 5, "dog", 1, 1, 1, 1, [5, 1, 10])], "frame long, track long, label string, x int, y int, width int, height int, rle array<int>")
    writers.write_tracks(videos, frames, objects, objects.select("label"), str(tmp_path / "t.json"))
    doc = json.loads((tmp_path / "t.json").read_text())
    assert doc["videos"][0]["length"] == 3 and doc["annotations"][0]["bboxes"] == [None, [1, 1, 1, 1], None] and doc["annotations"][0]["segmentations"][1]["counts"] == [5, 1, 10]


def test_catalog_changes(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "tag long, name string")
    with pytest.raises(ValueError):
        catalog.rename_tag(tags, "a", "b")
    captions = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    changes = spark.createDataFrame([(2, None), (3, "z")], "id long, text string")
    assert rows(catalog.put_captions(captions, changes, "id"), "id", "text") == [(1, "x"), (3, "z")]
    with pytest.raises(Exception, match="a caption has a text"):
        catalog.put_captions(captions, spark.createDataFrame([(3, "  ")], "id long, text string"), "id").collect()
    with pytest.raises(Exception, match="no such track"):
        catalog.attach_tracks(captions, spark.createDataFrame([(9,)], "track long"), spark.createDataFrame([(1, 8)], "id long, track long"), "id", "track").collect()
    assert spark.range(1).select(catalog.copy_name(F.lit("my set of my set"), "my set", "new")).first()[0] == "new of my set"
    found = catalog.outcomes(spark.createDataFrame([("a",), ("b",)], "path string"), captions.select(F.lit("z").alias("path")), "path", F.lit(False), F.lit(True))
    with pytest.raises(Exception, match="no file could be read"):
        catalog.outcome_report(found).collect()


def test_few_shot(spark):
    rng = np.random.default_rng(5)
    data = [(i, "ab"[i % 2], (rng.normal(size=3) + 3 * (i % 2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>")
    made = fewshot.train(df, ["a", "none", "b"])
    told = {r["vec_id"]: r["probabilities"] for r in fewshot.predict(made, df).collect()}
    assert all(p[1] == 0 and abs(sum(p) - 1) < 1e-9 for p in told.values())
    plain = {r["vec_id"]: r["probabilities"] for r in fewshot.predict_portable(fewshot.portable(made), df).collect()}
    assert all(np.allclose(told[i], plain[i]) for i in told)
    with pytest.raises(ValueError):
        fewshot.train(df, ["a"])
    with pytest.raises(Exception, match="no such class"):
        fewshot.relabelled(df, df.limit(1).withColumn("label", F.lit("new")), ["a", "b"]).collect()


def test_models_and_projection(spark):
    models = embeddings.Models()
    with pytest.raises(ValueError):
        models.embed(spark.range(1), "id", "id")
    models.register("one", embeddings.hashed_model(4), 4)
    made = models.embed(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string"), "t", "id").orderBy("id").collect()
    assert made[0]["embedding"] == made[1]["embedding"] != made[2]["embedding"]
    two = spark.createDataFrame([(4, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert rows(embeddings.project(two), "vec_id", "x", "y") == [(2, 0.0, 0.0), (4, 1.0, 1.0)]


def test_cursor_pages(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "a long, id long")
    at, seen = None, []
    while (page := ordering.after(df, ["a", "id"], at, 4)).count():
        seen += [(r["a"], r["id"]) for r in page.collect()]
        at = ordering.cursor(page, ["a", "id"])
    assert seen == sorted((i % 3, i) for i in range(10))
