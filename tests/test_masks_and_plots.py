"""Indexed PNG masks, polygons as runs, the plot's colours and its stream."""

import io
import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import masks as M
from sievework.operators import plot
from sievework.sources import png_masks


def filtered_png(classes, bits=8, kinds=(0, 1, 2, 3, 4), colour=0):
    """A PNG whose rows take all filters in turn, by the format's own definition."""
    h, w = classes.shape
    packed = np.array([[int("".join(f"{v:0{bits}b}" for v in [*row, *[0] * 8][i : i + 8 // bits]).ljust(8, "0"), 2) for i in range(0, w, 8 // bits)] for row in classes.tolist()], np.int64)
    out, above = b"", np.zeros(packed.shape[1], np.int64)
    for y, line in enumerate(packed):
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        guess = left + above - corner
        apart = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        paeth = np.stack([left, above, corner])[apart.argmin(0), np.arange(len(line))]
        kind = kinds[y % len(kinds)]
        out += bytes([kind]) + ((line - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return png_masks.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)[:20]) + chunk(b"IDAT", zlib.compress(out)[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_png_of_all_filters_and_depths(bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (23, 37))
    assert (png_masks.decode_png(filtered_png(image, bits)) == image).all()
    assert (png_masks.decode_png(png_masks.encode_png(image.astype(np.uint8))) == image).all()


def test_damaged_png():
    raw = png_masks.encode_png(np.eye(9, dtype=np.uint8))
    for bad in (b"", raw[:40], raw[:60] + b"x" + raw[61:], filtered_png(np.eye(9, dtype=int), 8, colour=2)):
        with pytest.raises((ValueError, zlib.error)):
            png_masks.decode_png(bad)
    assert png_masks.palette()[:12] == bytes([0, 0, 0, 128, 0, 0, 0, 128, 0, 128, 128, 0])


def test_class_masks_go_out_and_come_back(spark, tmp_path):
    images = spark.createDataFrame([(1, "/a/one.jpg", 4, 3), (2, "/a/two.jpg", 3, 2)], "sample int, file_path_abs string, width int, height int")
    rows = [(1, 10, "cat", [1, 1, 2, 1, 7]), (1, 11, "dog", [7, 1, 2, 2]), (1, 9, "dog", [0, 2, 10]), (1, 12, "zebra", None)]
    masks = spark.createDataFrame(rows, "sample int, id int, label string, rle array<bigint>")
    labels = masks.select("label").distinct()
    png_masks.write_class_masks(images, masks, labels, f"file://{tmp_path}/out")
    names = {int(k): v for k, v in json.loads((tmp_path / "out" / "class_id_to_name.json").read_text()).items()}
    assert names == {0: "background", 1: "cat", 2: "dog", 3: "zebra"}
    back = {(r.stem, r.label): (r.x, r.y, r.width, r.height, r.rle) for r in png_masks.read_class_masks(spark, f"{tmp_path}/out/SegmentationClass", names).collect()}
    assert back == {
        ("one", "background"): (0, 0, 4, 3, [2, 2, 1, 2, 1, 2, 2]), ("one", "cat"): (0, 0, 2, 2, [1, 1, 2, 1, 7]), ("one", "dog"): (0, 0, 4, 3, [0, 1, 6, 1, 2, 2]),
        ("two", "background"): (0, 0, 3, 2, [0, 6]),
    }
    with pytest.raises(Exception, match="a class without a name: 2"):
        png_masks.read_class_masks(spark, f"{tmp_path}/out/SegmentationClass", {0: "bg", 1: "cat"}).collect()
    with pytest.raises(ValueError, match="several images"):
        png_masks.write_class_masks(images.withColumn("file_path_abs", F.lit("/a/x.jpg")), masks, labels, f"file://{tmp_path}/again")


def fill(polygons, w, h):
    out = np.zeros((h, w), int)
    for p in polygons:
        corners = list(zip(p[::2], p[1::2], strict=False))
        if len(corners) < 3:
            continue
        for y in range(h):
            for x in range(w):
                inside = False
                for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], corners[0]], strict=True):
                    if (ya <= y + 0.5) != (yb <= y + 0.5) and x + 0.5 >= xa + (y + 0.5 - ya) * (xb - xa) / (yb - ya):
                        inside = not inside
                out[y, x] |= inside
    return out


def test_polygons_as_runs(spark):
    rng = random.Random(6)
    cases = [([[1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0]], 6, 5), ([[0.0, 0.0, 6.0, 0.0, 6.0, 5.0, 0.0, 5.0]], 6, 5), ([], 3, 2), ([[1.0, 1.0, 2.0, 2.0]], 3, 2), ([[-5.0, -5.0, 50.0, -5.0, 50.0, 2.0, -5.0, 2.0], [0.0, 1.0, 9.0, 1.0, 9.0, 9.0]], 6, 5)]
    cases += [([[rng.uniform(-3, 16) for _ in range(2 * rng.randrange(3, 8))] for _ in range(rng.randrange(1, 4))], 13, 11) for _ in range(60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<array<double>>, w int, h int")
    made = {r.i: r.r for r in df.select("i", M.polygon_runs(F.col("p"), F.col("w"), F.col("h")).alias("r")).collect()}
    for i, (polygons, w, h) in enumerate(cases):
        assert made[i] == png_masks._runs(fill(polygons, w, h).ravel()), i
    assert df.select(M.polygon_runs(F.lit(None).cast("array<array<double>>"), F.lit(2), F.lit(2)).alias("r")).first().r is None


def test_colours_by_frequency(spark):
    values = spark.createDataFrame([(i, f"v{j:03d}") for i in range(260) for j in range(i % 260)] + [(1, None), (5, "v000"), (5, "v000")], "key int, value string")
    scale, legend = plot.frequency_scale(values)
    slots = {r.value: r.slot for r in scale.collect()}
    assert len(slots) == 259 and slots["v000"] == 3 and slots["v251"] == 254 and {slots[f"v{j}"] for j in range(252, 259)} == {255}
    assert legend[254] == "v251" and legend[255] == "Other (v252, v253, v254, v255, v256, …)" and len(legend) == 253
    scale, legend = plot.frequency_scale(values, spark.createDataFrame([(2,), (3,)], "key int"))
    assert legend == {3: "v000", 4: "v001", 5: "v002"} and scale.count() == 3
    found = {r.key: r.categories for r in plot.categories(values.select("key").distinct(), values, scale).collect()}
    assert found[1] == [3] and found[9] == [3, 4, 5] and found[2] == [3, 4]
    assert plot.frequency_scale(values.limit(0))[1] == {}


def test_colours_of_integers(spark):
    values = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "key int, value int")
    scale, legend = plot.integer_scale(values([5, 3, 3, None]))
    assert legend == {3: "3", 4: "5"} and {r.value: r.slot for r in scale.collect()} == {3: 3, 5: 4}
    scale, legend = plot.integer_scale(values(range(0, 1241, 10)))
    assert legend[3] == "0-29" and legend[44] == "1230-1259" and {r.value: r.slot for r in scale.collect()}[1240] == 44
    scale, legend = plot.integer_scale(values([*range(52), 60]))
    assert legend[3] == "0-1" and max(legend) == 33
    assert plot.integer_scale(values([None]))[1] == {}


def test_plot_stream_is_read_by_arrow(spark):
    points = spark.createDataFrame([(i, i / 2, -float(i)) for i in range(500)] + [(900, None, 1.0)], "key int, x double, y double").repartition(3)
    values = points.select("key", (F.col("key") % 4).cast("string").alias("value")).where("key % 5 <> 0")
    scale, legend = plot.frequency_scale(values)
    sent = plot.messages(points, legend, points.where("key < 100"), plot.categories(points, values, scale))
    table = pa.ipc.open_stream(io.BytesIO(b"".join(plot.stream(sent)))).read_all()
    assert table.schema.equals(plot.schema(legend), check_metadata=True) and json.loads(table.schema.metadata[b"color_legend"]) == {str(k): v for k, v in legend.items()}
    rows = {r["sample_id"]: r for r in table.to_pylist()}
    assert len(rows) == 500 == table.num_rows and rows["7"]["x"] == 3.5 and rows["99"]["fulfils_filter"] == 1 and rows["100"]["fulfils_filter"] == 0
    assert rows["5"]["color_categories"] == [] and legend[rows["6"]["color_categories"][0]] == "2"
    empty = pa.ipc.open_stream(io.BytesIO(b"".join(plot.stream(plot.messages(points.limit(0), {}))))).read_all()
    assert empty.num_rows == 0 and empty.schema.equals(plot.schema({}), check_metadata=True)
