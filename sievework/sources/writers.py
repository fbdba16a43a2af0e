"""Writers of annotation formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.scratch import cut


def dense_ids(names: DataFrame, column: str, first: int = 0) -> DataFrame:
    """(column, id): distinct names numbered in alphabetical order from `first`."""
    return number_rows(names.select(column).where(F.col(column).isNotNull()).distinct(), [column], "id", first).select(column, F.col("id").cast("int").alias("id"))


def number_rows(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """`rows` numbered in a global order without bringing them into one task.

    Rows are range-partitioned and sorted once and kept; each partition is counted, and a row's number
    is its place plus the counts before it.
    """
    from pyspark.sql import Window

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("__p", F.shiftright("__m", 33)).withColumn("__m", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__p").agg(F.count("*").alias("n"))  # a row per partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__m") + first).drop("__p", "__m", "__o")


def classification_rows(annotations: DataFrame, images: DataFrame, source: str | None = None) -> DataFrame:
    """(file_path_abs, class_name, confidence, annotation_source) of whole-image classes."""
    rows = annotations.where("start_s IS NULL") if "start_s" in annotations.columns else annotations
    rows = rows.where(F.col("annotation_source") == source) if source else rows
    return rows.join(images.select("sample", "file_path_abs"), "sample").select("file_path_abs", F.col("label").alias("class_name"), "confidence", "annotation_source")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def detection_tables(images: DataFrame, boxes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, annotations) with the ids of a detection export: images by path, categories by name, from 0.

    Masks (rle, row by row) go along as `segmentation` where `boxes` has them.
    """
    numbered = number_rows(images, ["file_path_abs"], "id")
    categories = dense_ids(labels, "label")
    joined = boxes.join(numbered.select("sample", F.col("id").alias("image_id"), F.col("width").alias("iw"), F.col("height").alias("ih")), "sample").join(categories.withColumnRenamed("id", "category_id"), "label")
    shape = ["image_id", "category_id", F.array("x", "y", "width", "height").alias("bbox")]
    if "rle" in boxes.columns:
        from sievework.functions.masks import area, column_runs

        joined = joined.where("rle IS NOT NULL")
        shape += [area(F.col("rle")).alias("area"), F.struct(F.array("ih", "iw").alias("size"), column_runs(F.col("rle"), F.col("iw"), F.col("ih")).alias("counts")).alias("segmentation"), F.lit(1).alias("iscrowd")]
    return numbered.select("id", F.col("file_path_abs").alias("file_name"), "width", "height"), categories.select("id", F.col("label").alias("name")), joined.select(*shape)


def caption_tables(images: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a caption export: images by path, captions by image and text, each from 0."""
    numbered = number_rows(images, ["file_path_abs"], "id")
    rows = captions.join(numbered.select("sample", F.col("id").alias("image_id")), "sample").select("image_id", F.col("text").alias("caption"))
    return numbered.select("id", F.col("file_path_abs").alias("file_name"), "width", "height"), number_rows(rows, ["image_id", "caption"], "id").select("id", "image_id", "caption")


def track_tables(videos: DataFrame, frames: DataFrame, objects: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, categories, annotations) of a video-instance export, ids from 1, categories by name.

    videos: video, path, width, height; frames: frame, video, number; objects: frame, track, label, x, y,
    width, height, rle. An annotation has an entry per frame of its video, null where the object is not
    seen: those gaps come from the frames' own count, so only present entries are shuffled.
    """
    from pyspark.sql import Window

    placed = frames.withColumn("at", F.row_number().over(Window.partitionBy("video").orderBy("number")) - 1)
    length = placed.groupBy("video").agg(F.count("*").alias("length"))
    numbered = number_rows(videos.join(length, "video", "left").na.fill(0, ["length"]), ["path"], "id", 1)
    categories = dense_ids(labels, "label", 1)
    seen = objects.where("rle IS NOT NULL").join(placed.select("frame", "video", "at"), "frame")
    held = seen.groupBy("video", "track").agg(F.max_by("label", "at").alias("label"), F.map_from_entries(F.collect_list(F.struct("at", F.struct(F.array("x", "y", "width", "height").alias("box"), "rle")))).alias("m"))
    joined = held.join(numbered.select("video", F.col("id").alias("video_id"), "length", F.array("height", "width").alias("size")), "video").join(categories.select("label", F.col("id").alias("category_id")), "label")
    every = F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)).cast("int"))
    made = joined.select("video_id", "category_id", "track", F.transform(every, lambda i: F.col("m")[i]["box"]).alias("bboxes"), F.transform(every, lambda i: F.when(F.col("m")[i].isNotNull(), F.struct(F.col("m")[i]["rle"].alias("counts"), F.col("size").alias("size")))).alias("segmentations"))
    out = number_rows(made, ["video_id", "track"], "id", 1)
    return numbered.select("id", F.col("path").alias("file_name"), "width", "height", "length"), categories.select("id", F.col("label").alias("name")), out


def write_document(path: str, **tables: DataFrame) -> None:
    """One JSON document at `path`: an object with an array per table, its rows in the order of their id.

    Rows become lines in parallel and are sorted by section and id; as it is one file, one task writes
    it, line by line. The folder of Spark's writer is then replaced by its only file.
    """
    spark = next(iter(tables.values())).sparkSession
    lines = None
    for i, (name, rows) in enumerate(tables.items()):
        place = F.col("id").cast("long") if "id" in rows.columns else F.monotonically_increasing_id()
        # A comma stands before every row; the first of a section follows an empty line, so it has none.
        body = number_rows(rows.select(place.alias("o"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")), ["o"], "at")
        body = body.select(F.lit(i).alias("s"), F.col("at").cast("long").alias("at"), F.when(F.col("at") > 0, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
        head = ("{" if i == 0 else ",") + f'"{name}":['
        ends = spark.createDataFrame([(i, -1, head), (i, (1 << 62), "]}" if i == len(tables) - 1 else "]")], "s int, at long, value string")
        part = ends.unionByName(body)
        lines = part if lines is None else lines.unionByName(part)
    lines.orderBy("s", "at").coalesce(1).select("value").write.text(f"{path}.parts")
    _only_file(spark, f"{path}.parts", path)


def _files(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _only_file(spark, folder: str, path: str) -> None:
    fs, at = _files(spark, folder)
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    target = _files(spark, path)[1]
    if fs.exists(target) or not fs.rename(part, target):
        raise FileExistsError(path)
    fs.delete(at, True)


def write_detections(images: DataFrame, boxes: DataFrame, labels: DataFrame, path: str) -> None:
    """A detection document; with masks (rle) in `boxes`, an instance-mask document. See `detection_tables`."""
    made = detection_tables(images, boxes, labels)
    write_document(path, images=made[0], categories=made[1], annotations=number_rows(made[2], ["image_id", "category_id", "bbox"], "id"))


def write_captions(images: DataFrame, captions: DataFrame, path: str) -> None:
    made = caption_tables(images, captions)
    write_document(path, images=made[0], annotations=made[1])


def write_tracks(videos: DataFrame, frames: DataFrame, objects: DataFrame, labels: DataFrame, path: str) -> None:
    made = track_tables(videos, frames, objects, labels)
    write_document(path, videos=made[0], categories=made[1], annotations=made[2])


def label_lines(images: DataFrame, boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, value): lines `class cx cy w h` in shares of the image's size, classes by name from 0."""
    ids = dense_ids(labels, "label")
    stem = F.regexp_extract("file_path_abs", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = boxes.join(images.select("sample", stem.alias("stem"), F.col("width").alias("iw"), F.col("height").alias("ih")), "sample").join(ids, "label")
    value = F.concat_ws(" ", F.col("id").cast("string"), (F.col("x") + F.col("width") / 2) / F.col("iw"), (F.col("y") + F.col("height") / 2) / F.col("ih"), F.col("width") / F.col("iw"), F.col("height") / F.col("ih"))
    return rows.select("stem", value.alias("value"))


def write_label_lines(images: DataFrame, boxes: DataFrame, labels: DataFrame, path: str, split: str = "train") -> None:
    """labels/<split>/<stem>.txt of `label_lines` for every image with boxes, and data.yaml with the classes.

    The format wants a file per image, so tasks write a folder per image and the driver renames each to
    its file; it sees names alone.
    """
    spark = images.sparkSession
    label_lines(images, boxes, labels).repartition("stem").write.partitionBy("stem").text(f"{path}/.parts")
    fs, parts = _files(spark, f"{path}/.parts")
    target = _files(spark, f"{path}/labels/{split}")[1]
    fs.mkdirs(target)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in fs.listStatus(parts):
        if folder.isDirectory():
            stem = unescape(folder.getPath().getName().partition("=")[2])
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, _files(spark, f"{path}/labels/{split}/{stem}.txt")[1])
    fs.delete(parts, True)
    names = [r["label"] for r in dense_ids(labels, "label").orderBy("id").collect()]  # classes are a small dimension
    out = fs.create(_files(spark, f"{path}/data.yaml")[1])
    import json

    out.write(bytearray("".join([f"path: .\n{split}: images/{split}\nnc: {len(names)}\nnames:\n", *[f"  {i}: {json.dumps(n, ensure_ascii=False)}\n" for i, n in enumerate(names)]]), "utf-8"))
    out.close()
