"""Class masks as indexed PNG files, one byte (or less) a pixel: written and read with zlib alone."""

from __future__ import annotations

import functools
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.masks import bounding_box
from sievework.sources.writers import dense_ids

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels whose runs a task holds before it hands them on.
PIXELS = 1 << 23
#: What class 0 is called.
BACKGROUND = "background"


@functools.cache
def palette() -> bytes:
    """256 colours that tell neighbouring class ids apart: bit k of an id goes to bit 7 - k // 3 of channel k mod 3."""
    out = np.zeros((256, 3), np.uint8)
    for bit in range(8):
        out[:, bit % 3] |= ((np.arange(256) >> bit & 1) << (7 - bit // 3)).astype(np.uint8)
    return out.tobytes()


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


@functools.cache
def _palette_chunk() -> bytes:
    return _chunk(b"PLTE", palette())


def encode_png(classes: np.ndarray) -> bytes:
    """An indexed PNG of a matrix of class ids (0 to 255)."""
    height, width = classes.shape
    lines = np.zeros((height, width + 1), np.uint8)  # a filter byte, none, before each row
    lines[:, 1:] = classes
    head = struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _palette_chunk() + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row's bytes from its filtered ones and the row above; a pixel is at most a byte, so the left neighbour is one byte away."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, dtype=np.uint8)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no such filter: {kind}")
    out, left, corner = [], 0, 0
    for x, up in zip(line.tolist(), above.tolist(), strict=True):
        if kind == 3:
            left = (x + (left + up) // 2) & 255
        else:
            guess = left + up - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            left, corner = (x + near) & 255, up
        out.append(left)
    return np.array(out, np.uint8)


def decode_png(raw: bytes) -> np.ndarray:
    """Class ids of an indexed or grey PNG of up to eight bits a pixel; interlaced and coloured ones fail."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            raise ValueError("a PNG file that is cut off or damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in (0, 3) or bits > 8 or interlaced:
        raise ValueError("class masks are indexed or grey, of at most eight bits, not interlaced")
    step = (width * bits + 7) // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) < height * (step + 1):
        raise ValueError("a PNG file that is cut off or damaged")
    lines = lines[: height * (step + 1)].reshape(height, step + 1)
    if not lines[:, 0].any():
        out = lines[:, 1:]
    else:
        out, above = np.empty((height, step), np.uint8), np.zeros(step, np.uint8)
        for y in range(height):
            out[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above)
    if bits < 8:
        out = np.packbits(np.unpackbits(out, axis=1).reshape(height, -1, bits), axis=2).reshape(height, -1) >> (8 - bits)
    return out[:, :width]


def _runs(bits: np.ndarray) -> list[int]:
    """Runs of a flat array of 0 and 1, the first of zeros."""
    edges = np.flatnonzero(np.diff(np.r_[0, bits]))
    return np.diff(np.r_[0, edges, len(bits)]).tolist()


def _class_runs(flat: np.ndarray) -> dict[int, list[int]]:
    """Runs of each class of a flat array of class ids, the first of other classes; classes in their order."""
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts = [0, *edges.tolist()] if len(flat) else []
    found: dict[int, list[int]] = {}
    ends: dict[int, int] = {}
    for start, stop, c in zip(starts, [*starts[1:], len(flat)], flat[starts].tolist(), strict=False):
        found.setdefault(c, []).extend((start - ends.get(c, 0), stop - start))
        ends[c] = stop
    for c, stop in ends.items():
        if stop < len(flat):
            found[c].append(len(flat) - stop)
    return dict(sorted(found.items()))


def to_png(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): the class mask of each group of masks (keys, width, height, at, class_id, rle) as PNG bytes.

    Where masks overlap, the one of the largest `at` stays. Rows are sorted within a task and painted one by one, so a task
    holds one image at a time, however many masks it has. Class ids are 1 to 255; a size that differs within a group fails.
    """
    order = [*keys, "at", "class_id"]
    rows = masks.select(*keys, "width", "height", "at", "class_id", "rle").repartition(*keys).sortWithinPartitions(*order)
    kinds = ", ".join(f"{k} {masks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        name, image, flat = None, None, None
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("width", "height", "class_id", "rle"))
            for own, width, height, class_id, rle in zip(zip(*(batch[k] for k in keys), strict=True), *columns, strict=True):
                if own != name:
                    if name is not None:
                        out.append((*name, encode_png(image)))
                    name, image = own, np.zeros((int(height), int(width)), np.uint8)
                    flat = image.reshape(-1)
                if image.shape != (height, width):
                    raise ValueError(f"masks of different sizes: {own}")
                if rle is not None:
                    if not 1 <= class_id <= 255:
                        raise ValueError(f"class ids are 1 to 255, not {class_id}")
                    at, runs = 0, rle.tolist()
                    for off, on in zip(runs[::2], runs[1::2], strict=False):
                        at += off
                        flat[at : at + on] = class_id
                        at += on
            yield pd.DataFrame(out, columns=[*keys, "content"])
        if name is not None:
            yield pd.DataFrame([(*name, encode_png(image))], columns=[*keys, "content"])

    return rows.mapInPandas(run, f"{kinds}, content binary")


def from_png(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, class_id, width, height, rle) of each class that a PNG class mask has, 0 included; runs go row by row."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        columns = ["k", "class_id", "width", "height", "rle"]
        for batch in batches:
            rows, pixels = [], 0
            for name, raw in zip(batch["k"], batch["c"], strict=True):
                image = decode_png(bytes(raw))
                rows += [(name, c, image.shape[1], image.shape[0], runs) for c, runs in _class_runs(image.ravel()).items()]
                pixels += image.size
                if pixels > PIXELS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, pixels = [], 0
            yield pd.DataFrame(rows, columns=columns)

    made = files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, class_id int, width int, height int, rle array<bigint>")
    return made.withColumnRenamed("k", key)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def read_class_masks(spark: SparkSession, folder: str, names: dict[int, str]) -> DataFrame:
    """(stem, label, x, y, width, height, rle) of the PNG class masks in a folder; the box is that of the class's pixels.

    A class that `names` lacks fails the job. Runs cover the whole image, row by row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(folder)
    found = from_png(files.select(_stem(F.col("path")).alias("stem"), "content"), "stem")
    label = F.element_at(F.create_map(*[F.lit(x) for i, n in names.items() for x in (int(i), n)]), F.col("class_id"))
    checked = F.coalesce(label, F.raise_error(F.concat(F.lit("a class without a name: "), F.col("class_id").cast("string"))).cast("string"))
    boxed = found.select("stem", checked.alias("label"), bounding_box(F.col("rle"), F.col("width")).alias("b"), "rle")
    return boxed.select("stem", "label", *[F.col(f"b.{c}").cast("int").alias(c) for c in ("x", "y", "width", "height")], "rle")


def write_class_masks(images: DataFrame, masks: DataFrame, labels: DataFrame, path: str) -> None:
    """SegmentationClass/<stem>.png for every image, blank without masks, and class_id_to_name.json.

    images: sample, file_path_abs, width, height; masks: sample, id, label, rle. Classes are numbered from 1 in
    alphabetical order, 0 is the background; of overlapping masks the one with the largest id shows. Tasks write
    the files by the URI's own file system, so a repeated task writes the same file again. Images of one stem are one file, and fail.
    """
    spark = images.sparkSession
    ids = dense_ids(labels, "label", 1)
    named = [(0, BACKGROUND), *[(r["id"], r["label"]) for r in ids.orderBy("id").limit(256).collect()]]  # more than 255 classes fail
    if len(named) > 256:
        raise ValueError("a mask has at most 255 classes")
    placed = masks.join(ids.withColumnRenamed("id", "class_id"), "label").select("sample", F.col("id").alias("at"), "class_id", "rle")
    rows = images.select("sample", _stem(F.col("file_path_abs")).alias("stem"), "width", "height")
    twice = rows.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several images are called {twice[0]['stem']}")
    made = to_png(rows.join(placed, "sample", "left").drop("sample"), ["stem"])

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/SegmentationClass", recursive=True)
        for batch in batches:
            for stem, content in zip(batch["stem"], batch["content"], strict=True):
                with store.open_output_stream(f"{root}/SegmentationClass/{stem}.png") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    made.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/class_id_to_name.json")
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(json.dumps({str(i): n for i, n in named}, ensure_ascii=False), "utf-8"))
    out.close()
