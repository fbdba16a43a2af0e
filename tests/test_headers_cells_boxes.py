"""Image headers and outcomes, exact neighbours by cells, box matching in large groups, trees of any depth."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.images import header
from sievework.operators import catalog, cells, embeddings, evaluate, selection
from sievework.sources import readers
from sievework.streaming.ingest import ingest_new


def png(w, h, crc=None):
    chunk = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + chunk + struct.pack(">I", zlib.crc32(chunk) if crc is None else crc) + b"x" * 50


def jpeg(w, h, segments=3, fill=0, frame=0xC0, size=60_000):
    out = b"\xff\xd8"
    for i in range(segments):
        out += b"\xff" * fill + bytes([0xFF, 0xE0 + i % 16]) + struct.pack(">H", size + 2) + b"\xff\xc0" * (size // 2)
    return out + b"\xff\xdb\x00\x04ab" + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, h, w) + bytes(12)


def tiff(w, h, order, long):
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 20) + b"p" * 12 + struct.pack(order + "H", 3)
    for tag, kind, value in ((254, 4, 0), (256, 4 if long else 3, w), (257, 4 if long else 3, h)):
        out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "I", value) if kind == 4 else struct.pack(order + "HH", value, 0))
    return out


WEBP = b"RIFF\0\0\0\0WEBP"
HEADERS = {
    "png": (png(640, 480), ("png", 640, 480)), "png with a wrong checksum": (png(1, 2, 5), None), "png cut off": (png(1, 2)[:28], None),
    "jpeg": (jpeg(1920, 1080), ("jpeg", 1920, 1080)), "jpeg with fill bytes": (jpeg(3, 4, 40, 2, 0xC2, 1000), ("jpeg", 3, 4)), "jpeg cut off": (jpeg(3, 4)[:-20], None), "jpeg without a frame": (b"\xff\xd8\xff", None),
    "gif": (b"GIF89a" + struct.pack("<HH", 10, 20), ("gif", 10, 20)), "bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 31, -17), ("bmp", 31, 17)), "old bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 31, 17) + bytes(4), ("bmp", 31, 17)),
    "lossy webp": (WEBP + b"VP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 300 | 0x4000, 200), ("webp", 300, 200)), "lossless webp": (WEBP + b"VP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 299 | (199 << 14)), ("webp", 300, 200)),
    "extended webp": (WEBP + b"VP8X" + bytes(8) + (4999).to_bytes(3, "little") + (99).to_bytes(3, "little"), ("webp", 5000, 100)),
    "tiff": (tiff(70, 80, "<", False), ("tiff", 70, 80)), "long tiff": (tiff(70_000, 80, ">", True), ("tiff", 70_000, 80)), "big-endian tiff": (tiff(7, 8, ">", False), ("tiff", 7, 8)), "tiff cut off": (tiff(7, 8, "<", True)[:30], None),
    "too many pixels": (png(20_000, 20_000), None), "no pixel": (png(0, 5), None), "text": (b"hello", None), "empty": (b"", None), "null": (None, None),
}


def test_headers(spark):
    rows = [(name, None if raw is None else bytearray(raw)) for name, (raw, _) in HEADERS.items()]
    got = {r.n: tuple(r.h) if r.h else None for r in spark.createDataFrame(rows, "n string, c binary").select("n", header(F.col("c")).alias("h")).collect()}
    assert got == {name: want for name, (_, want) in HEADERS.items()}


def test_images_are_added_once_with_their_outcomes(spark, tmp_path):
    for name, raw in (("a/one.png", png(10, 20)), ("a/two.JPG", jpeg(30, 40)), ("b/bad.png", b"no image"), ("b/old.png", png(1, 1)), ("b/notes.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    files = readers.read_images(spark, str(tmp_path))
    assert files.count() == 4
    at = lambda name: f"{tmp_path}/{name}"
    wanted = spark.createDataFrame([(at(n),) for n in ("a/one.png", "a/one.png", "a/two.JPG", "b/bad.png", "b/bad.png", "b/old.png", "b/gone.png")] + [(None,)], "path string")
    images, told = catalog.add_images(wanted, files, spark.createDataFrame([(at("b/old.png"),)], "path string"))
    assert {(r.file_name, r.width, r.height) for r in images.collect()} == {("one.png", 10, 20), ("two.JPG", 30, 40)}
    counts = {r.outcome: r.n for r in catalog.outcome_report(told).collect()}
    assert counts == {"ADDED": 2, "ALREADY_PRESENT": 2, "BROKEN": 2, "MISSING": 2}
    _, failed = catalog.add_images(spark.createDataFrame([(at("b/bad.png"),)], "path string"), files, images)
    with pytest.raises(Exception, match="no file could be read"):
        catalog.outcome_report(failed).collect()
    assert [r.path.rpartition("/")[2] for r in readers.list_files(spark, str(tmp_path), limit=2).collect()] == ["one.png", "two.JPG"]
    tags = {(r.path.rpartition("/")[2], r.tag) for r in readers.directory_tags(readers.list_files(spark, [at("a"), at("b/old.png")]), str(tmp_path), 1).collect()}
    assert tags == {("one.png", "a"), ("two.JPG", "a"), ("old.png", "b")}


def test_stream_fails_on_a_broken_target(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "path string, n int").write.parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):
        ingest_new(spark, str(tmp_path / "in"), "path string, n int", str(tmp_path / "out"), str(tmp_path / "log"))


def lists_of(found, names):
    got = {r.k: [n.d for n in r.near] for r in found.lists.collect()}
    return np.array([got[n] for n in names])


def test_neighbours_are_exact_and_meet_few_blocks(spark):
    rng = np.random.default_rng(1)
    shares = []
    for n in (600, 2400):
        x = (rng.normal(size=(n // 100, 12)) * 10)[rng.integers(0, n // 100, n)] + rng.normal(size=(n, 12)) * 0.1
        x[5 : 5 + n // 4] = x[5]  # one large group of equal vectors
        names = [f"id{i:05d}" for i in range(n)]
        rows = spark.createDataFrame([(k, v.tolist()) for k, v in zip(names, x, strict=True)], "k string, v array<double>")
        found = cells.neighbours(rows, None, 10, 64)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        assert np.allclose(lists_of(found, names), np.sort(far, 1)[:, :10], atol=1e-9)
        shares.append(found.met / found.pairs)
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    want = {(f"id{i:05d}", f"id{j:05d}", float(near[i, j])) for i in range(0, n, 100) for j in np.lexsort((np.arange(n), -near[i]))[:7]}
    got = {(r.query_id, r.k, r.similarity) for r in embeddings.search(rows, rows.where("k like '%00'"), 7, "k", "v", 64).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want} and max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want), strict=True)) < 2e-9


def test_neighbours_edges(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), (None, [1.0, 1.0])], "k string, v array<double>")
    assert {r.k: round(r.typicality, 6) for r in embeddings.typicality(rows, 20, "k", "v").collect()} == {"a": 0.367879, "b": 0.367879}
    assert embeddings.typicality(rows.where("k = 'a'"), 20, "k", "v").collect() == []
    assert embeddings.search(rows.limit(0), rows, 3, "k", "v").collect() == []
    assert [(r.query_id, r.k) for r in embeddings.search(rows, rows.where("k = 'b'"), 3, "k", "v").collect()] == [("b", "b")]


BOXES = "sample long, id long, label string, x int, y int, width int, height int"


def greedy(gt, pred, least, by_class):
    def iou(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (3, 4))
        union = float(a[5] * a[6]) + float(b[5] * b[6]) - w * h
        return w * h / union if union > 0 else 0.0

    groups, out = defaultdict(lambda: ([], [])), Counter()
    for side, rows in enumerate((gt, pred)):
        for r in rows:
            groups[(r[0], r[2]) if by_class else (r[0],)][side].append(r)
    for key, (truths, asked) in groups.items():
        free = [] if None in key else sorted(truths, key=lambda r: r[1])
        for p in sorted(asked, key=lambda r: (-(r[7] or 0), r[1])):
            best = max(((iou(g, p), -i) for i, g in enumerate(free)), default=(0, 0))
            if best[0] >= least:
                out[key[0], free.pop(-best[1])[1], p[1], round(best[0], 9)] += 1
            else:
                out[key[0], None, p[1], None] += 1
        for g in truths if None in key else free:
            out[key[0], g[1], None, None] += 1
    return out


def boxes(rng, n, samples, conf, first, wide=60):
    row = lambda i: (rng.choice(samples), first + i, rng.choice(["a", "b", None]), rng.randrange(wide), rng.randrange(wide), rng.randrange(14), rng.randrange(14))
    return [row(i) + ((rng.choice([None, 0.1, 0.5, 0.5, 0.9]),) if conf else ()) for i in range(n)]


@pytest.mark.parametrize(("group", "least", "by_class"), [(256, 0.5, True), (8, 0.3, False)])
def test_boxes_match_greedily_in_groups_of_any_size(spark, monkeypatch, group, least, by_class):
    monkeypatch.setattr(evaluate, "GROUP", group)
    rng = random.Random(4)
    samples = [1] * 20 + [2, 3, 4, None]
    gt, pred = boxes(rng, 500, samples, False, 0), boxes(rng, 550, samples, True, 5000)
    gt, pred = [*gt, gt[0]], [*pred, pred[1]]  # repeated rows are boxes each
    found = evaluate.match_boxes(spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES + ", confidence double"), least, by_class)
    assert Counter((r.sample, r.gt_id, r.pred_id, r.iou and round(r.iou, 9)) for r in found.collect()) == greedy(gt, pred, least, by_class)


def test_one_sample_of_many_boxes(spark):
    rng = random.Random(9)
    gt = [(7, i, "a", rng.randrange(9_000), rng.randrange(9_000), rng.randrange(20, 60), rng.randrange(20, 60)) for i in range(4_000)]
    pred = [(7, 10**6 + r[1], "a", r[3] + rng.randrange(-6, 7), r[4] + rng.randrange(-6, 7), r[5], r[6], rng.random()) for r in gt]
    found = evaluate.match_boxes(spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES + ", confidence double"))
    counts = evaluate.sample_counts(found).first()
    assert counts.tp + counts.fn == 4_000 == counts.tp + counts.fp and counts.tp > 2_000
    with pytest.raises(ValueError):
        evaluate.match_boxes(spark.createDataFrame(gt[:1], BOXES), spark.createDataFrame(pred[:1], BOXES + ", confidence double"), 0)


def test_trees_of_any_depth(spark):
    chain = [(0, None, "r"), *[(i, i - 1, f"n{i}") for i in range(1, 100)], (200, 999, "lost"), (201, 200, "too"), (300, None, None), (301, 300, "x")]
    rows = {r.k: (r.root, r.level, r.path) for r in catalog.hierarchy(spark.createDataFrame(chain, "k int, p int, n string"), "k", "p", "n").collect()}
    assert len(rows) == 102 and rows[99] == (0, 99, "/".join(["r", *[f"n{i}" for i in range(1, 100)]])) and rows[301] == (300, 1, "x")
    with pytest.raises(ValueError, match="loop"):
        catalog.hierarchy(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "k int, p int, n string"), "k", "p", "n")


def test_sequences_keep_long_video_names_apart(spark):
    a, b = "video-with-a-long-common-prefix-A", "video-with-a-long-common-prefix-B"
    frames = spark.createDataFrame([(f"{v}{i}", v, i, [float(i), float(v == b)]) for v in (a, b) for i in range(4)], "k string, v string, i int, e array<double>")
    picked = {r.k for r in selection.sequences(frames, 2, 2, "k", "v", "i", "e").collect()}
    assert picked == {f"{a}0", f"{a}1"}
    numbered = spark.createDataFrame([(100 * v + i, v, i, [float(v)]) for v in (2, 10, -3) for i in range(2)], "k int, v int, i int, e array<double>")
    assert {r.k for r in selection.sequences(numbered, 2, 2, "k", "v", "i", "e").collect()} == {-300, -299}


def test_selection_with_nulls_and_many_chosen(spark):
    rows = spark.createDataFrame([(1, [0.0], ["a"]), (2, None, None), (3, [9.0], ["b"]), (None, [5.0], ["a"]), (4, [4.0], []), (5, [8.5], ["b", "b"])], "k int, e array<double>, labels array<string>")
    assert [r.k for r in selection.diverse(rows, 9, "k", "e").orderBy("step").collect()] == [1, 3, 4, 5]
    chosen = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.k for r in selection.diverse(rows, 2, "k", "e", chosen=chosen).orderBy("step").collect()] == [3, 4]
    kept = rows.where("k is not null")
    assert [r.k for r in selection.balanced(kept, 2, "k", "uniform").orderBy("step").collect()] == [1, 3]
    assert selection.balanced(kept, 9, "k", "uniform").count() == 5
    ranked = selection.select(rows.where("k is not null").withColumn("w", F.col("k") % 3), 3, "k", selection.Strategy(weights=[("w", 1.0)]))
    assert [r.k for r in ranked.orderBy("step").collect()] == [2, 5, 1]
