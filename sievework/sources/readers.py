"""Readers of annotation formats; all give rows of path, label and shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.images import header

#: Extensions of files that count as images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff")
_DETECTION = "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,caption:string,segmentation:struct<size:array<int>,counts:array<long>>>>"


def list_files(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...] = IMAGE_EXTENSIONS, limit: int | None = None) -> DataFrame:
    """(path, length) of the files below `root` (a folder, a file, a glob or several) with one of the extensions, each once, without reading them.

    `limit`: at most so many, in the order of their paths.
    """
    found = _files(spark, root, extensions).select("path", "length").dropDuplicates(["path"])
    return found if limit is None else found.orderBy("path").limit(limit)


def _files(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...]) -> DataFrame:
    roots = [root] if isinstance(root, str) else list(root)  # folders, files or glob patterns
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return found.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))


def plain_path(path: Column) -> Column:
    """A local path without its scheme; paths of other stores as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, length, format, width, height) of the image files below `root`; the last three are null for files without a whole header.

    Headers are parsed where Spark reads the files, which it reads whole; see `functions.images.header`.
    """
    found = _files(spark, root, extensions).select("path", "length", header(F.col("content")).alias("h")).dropDuplicates(["path"])
    return found.select(plain_path(F.col("path")).alias("path"), "length", "h.format", "h.width", "h.height")


def directory_tags(files: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, tag): the names of the first `depth` folders below the root."""
    inner = F.split(F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), r"/?[^/]+$", ""), "/")
    return files.select("path", F.explode(F.slice(inner, 1, depth)).alias("tag")).where("tag <> ''").distinct()


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, annotation_id, label, x, y, width, height) of a detection JSON; corners are cut to whole pixels."""
    doc = spark.read.schema(_DETECTION).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    boxes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", F.col("a.bbox").alias("b"))
    boxes = boxes.join(images, "image_id").join(names, "category_id")
    return boxes.select("file_name", "annotation_id", "label", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x", "y", "width", "height"))])


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, caption) of a caption JSON, stripped; blank captions go."""
    doc = spark.read.schema(_DETECTION).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    texts = doc.select(F.explode("annotations").alias("a")).select("a.image_id", F.trim("a.caption").alias("caption")).where("caption <> ''")
    return texts.join(images, "image_id").select("file_name", "caption")


def read_label_lines(spark: SparkSession, root: str, names: list[str], sizes: DataFrame) -> DataFrame:
    """(stem, label, x, y, width, height) of text files of lines `class cx cy w h`, in shares of the image's size.

    `sizes`: stem, width, height.
    """
    lines = spark.read.text(root, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("stem"), F.split(F.trim("value"), r"\s+").alias("p"))
    lines = lines.where((F.col("stem") != "") & (F.size("p") >= 5)).join(sizes.select("stem", F.col("width").alias("iw"), F.col("height").alias("ih")), "stem")
    p = [F.col("p")[i].cast("double") for i in range(1, 5)]
    label = F.array(*map(F.lit, names))[F.col("p")[0].cast("int")]
    x, y = (p[0] - p[2] / 2) * F.col("iw"), (p[1] - p[3] / 2) * F.col("ih")
    return lines.select("stem", label.alias("label"), *[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (p[2] * F.col("iw"), "width"), (p[3] * F.col("ih"), "height"))])


def read_events(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(stem, label, start_s, end_s) of a temporal-event JSON: {"database": {stem: {"annotations": [...]}}}.

    Spans that do not begin before they end, or begin before zero, are left out; with `strict` they fail.
    """
    doc = spark.read.schema("database map<string, struct<annotations:array<struct<label:string,segment:array<double>>>>>").json(path, multiLine=True)
    rows = doc.select(F.explode("database").alias("stem", "v")).select("stem", F.explode("v.annotations").alias("a"))
    low, high = F.col("a.segment")[0], F.col("a.segment")[1]
    whole = F.coalesce((low >= 0) & (low < high), F.lit(False))
    rows = rows if strict else rows.where(whole)
    start = F.when(whole, low).otherwise(F.raise_error(F.concat(F.lit("a span that does not begin before it ends: "), "stem")).cast("double"))
    return rows.select("stem", "a.label", start.alias("start_s"), high.alias("end_s"))


def attach_events(events: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their video, stems without one) by the name of the video's file without folder and suffix.

    videos: video, path. Two videos of one stem fail the job, as an event could belong to either.
    """
    named = videos.select("video", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"), F.min("video").alias("v"))
    one = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several videos are called "), "stem")).cast(videos.schema["video"].dataType)).otherwise(F.col("v"))
    held = named.select("stem", one.alias("video"))
    return events.join(held, "stem"), events.select("stem").distinct().join(held, "stem", "left_anti")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, track, label, frame, x, y, width, height) of a video-instance JSON; frames without the object go."""
    doc = spark.read.schema("videos array<struct<id:long,file_names:array<string>>>, categories array<struct<id:long,name:string>>, annotations array<struct<id:long,video_id:long,category_id:long,bboxes:array<array<double>>>>").json(path, multiLine=True)
    videos = doc.select(F.explode("videos").alias("v")).select(F.col("v.id").alias("video_id"), F.col("v.file_names")[0].alias("file_name"))
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    tracks = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("track"), "a.video_id", "a.category_id", F.posexplode("a.bboxes").alias("frame", "b")).where("b IS NOT NULL")
    return tracks.join(videos, "video_id").join(names, "category_id").select("file_name", "track", "label", "frame", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x", "y", "width", "height"))])


def attach_tracks_to_videos(spark: SparkSession, path: str, root: str, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks with their video, file names without one) of a video-instance JSON; see `read_tracks`.

    videos: video, path, n_frames. A name with a suffix must be the path below `root`, one without meets the path
    without suffix; several such paths fail, and so does a video with another number of frames than the file says.
    """
    doc = spark.read.schema("videos array<struct<file_names:array<string>>>").json(path, multiLine=True)
    wanted = doc.select(F.explode("videos").alias("v")).select(F.col("v.file_names")[0].alias("file_name"), F.size("v.file_names").alias("wanted"))
    bare = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_name"))
    known = videos.select("video", "path", "n_frames", bare(F.col("path")).alias("bare"))
    many = known.groupBy("bare").agg(F.count("*").alias("n"), F.min("video").alias("video"), F.min("n_frames").alias("n_frames"))
    kind = videos.schema["video"].dataType
    single = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several videos are called "), "bare")).cast(kind)).otherwise(F.col("video"))
    suffixed = wanted.where(F.col("file_name").rlike(r"\.[^./]+$")).withColumn("path", full).join(known.select("path", "video", "n_frames"), "path").select("file_name", "wanted", "video", "n_frames")
    plain = wanted.where(~F.col("file_name").rlike(r"\.[^./]+$")).withColumn("bare", full).join(many, "bare").select("file_name", "wanted", single.alias("video"), "n_frames")
    found = suffixed.unionByName(plain)
    checked = F.when(F.col("wanted") != F.col("n_frames"), F.raise_error(F.concat(F.lit("another number of frames: "), "file_name")).cast(kind)).otherwise(F.col("video"))
    held = found.select("file_name", checked.alias("video"))
    return read_tracks(spark, path).join(held, "file_name"), wanted.select("file_name").join(held, "file_name", "left_anti")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, annotation_id, label, height, width, counts) of an instance-mask JSON; counts run column by column."""
    doc = spark.read.schema(_DETECTION).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    masks = doc.select(F.explode("annotations").alias("a")).where("a.segmentation.counts IS NOT NULL")
    masks = masks.select(F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", F.col("a.segmentation.size")[0].alias("height"), F.col("a.segmentation.size")[1].alias("width"), F.col("a.segmentation.counts").alias("counts"))
    return masks.join(images, "image_id").join(names, "category_id").select("file_name", "annotation_id", "label", "height", "width", "counts")


def read_splits(spark: SparkSession, config: str) -> tuple[list[str], dict[str, str]]:
    """(class names, folder by split) of a data.yaml with `names` as a list or a numbered map, and paths of splits.

    Only what such files hold is read: top-level scalars, and the names as a list or a map, each in
    brackets or a line an entry; comments go. Names in another form fail. Known splits: train, val, test, minival.
    """
    import re

    names: dict[int, str] = {}
    splits: dict[str, str] = {}
    item = r"""(?:"[^"]*"|'[^']*'|[^,#]*?)"""
    plain = lambda v: v[1:-1] if (v := v.strip())[:1] in ("'", '"') and v[-1:] == v[:1] else v
    bare = lambda v: re.sub(r"""^((?:[^'"#]|"[^"]*"|'[^']*')*?)\s+#.*$""", r"\1", v)  # noqa: E731  without a comment
    inside = False
    for line in map(bare, spark.read.text(config, wholetext=True).first()["value"].splitlines()):
        if line.lstrip().startswith("#"):
            continue
        if m := re.match(r"^(\w+)\s*:\s*(.*)$", line):
            inside = m[1] == "names"
            if inside and m[2].startswith("["):
                names = dict(enumerate(plain(v) for v in re.findall(rf"({item})(?:,|$)", m[2].strip()[1:].rstrip().removesuffix("]")) if v.strip()))
            elif inside and m[2].startswith("{"):
                names = {int(k): plain(v) for k, v in re.findall(rf"(\d+)\s*:\s*({item})\s*(?:,|$)", m[2].strip()[1:].rstrip().removesuffix("}"))}
            elif m[1] in ("train", "val", "test", "minival") and m[2].strip():
                splits[m[1]] = plain(m[2])
        elif inside and (m := re.match(r"^\s+(\d+)\s*:\s*(.+)$", line)):
            names[int(m[1])] = plain(m[2])
        elif inside and (m := re.match(r"^\s*-\s*(.+)$", line)):
            names[len(names)] = plain(m[1])
    if not names:
        raise ValueError(f"no class names in {config}")
    return [names[i] for i in sorted(names)], splits


def read_label_splits(spark: SparkSession, root: str, names: list[str], sizes: DataFrame, splits: list[str], limit: int | None = None) -> DataFrame:
    """`read_label_lines` of labels/<split> for each split, with the split as tag; `limit` images in all, splits in order, stems in order."""
    out = None
    for i, split in enumerate(splits):
        part = read_label_lines(spark, f"{root}/labels/{split}", names, sizes).withColumns({"tag": F.lit(split), "__s": F.lit(i)})
        out = part if out is None else out.unionByName(part)
    if limit is not None:
        kept = out.select("__s", "stem").distinct().orderBy("__s", "stem").limit(limit)
        out = out.join(kept, ["__s", "stem"], "left_semi")
    return out.drop("__s")


def read_native(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, label, x, y, width, height, confidence) of a folder with a JSON file per image.

    A file has file_name and predictions, each with category_id, bbox and score; schema.json beside them
    names the categories.
    """
    names = spark.read.schema("categories array<struct<id:long,name:string>>").json(f"{folder}/schema.json", multiLine=True).select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    files = spark.read.schema("file_name string, predictions array<struct<category_id:long,bbox:array<double>,score:double>>").json(f"{folder}/predictions", multiLine=True, recursiveFileLookup=True)
    rows = files.select("file_name", F.explode("predictions").alias("p")).select("file_name", F.col("p.category_id").alias("category_id"), F.col("p.bbox").alias("b"), F.col("p.score").alias("confidence"))
    return rows.join(names, "category_id").select("file_name", "label", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x", "y", "width", "height"))], "confidence")
