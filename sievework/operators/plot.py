"""Colours and record batches of the two-dimensional plot of a collection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of a legend, the first that values take, names inside the label of what shares the last one, and buckets of integers.
SLOTS, FIRST, NAMED, BUCKETS = 256, 3, 5, 50


def frequency_scale(values: DataFrame, matching: DataFrame | None = None) -> tuple[DataFrame, dict[int, str]]:
    """((value, slot), legend): a slot per value by its frequency among the matching samples, ties by value.

    values: key, value, of which a repeated row counts once; matching: key (None: all). Values that no
    matching sample has get no slot. Where values outnumber the slots, those beyond share the last one, whose
    label names the first of them. Null values are left out. Only as many rows as there are slots reach the driver.
    """
    held = values.where(F.col("value").isNotNull()).select("key", "value").distinct()
    counted = held if matching is None else held.join(matching.select("key").distinct(), "key", "left_semi")
    counts = counted.groupBy("value").agg(F.count("*").alias("n"))
    room = SLOTS - FIRST
    text = F.col("value").cast("string")
    head = counts.orderBy(F.desc("n"), text).limit(room + NAMED).select("value", text.alias("label")).collect()
    fits = len(head) <= room
    own = head if fits else head[: room - 1]
    legend = {FIRST + i: r["label"] for i, r in enumerate(own)}
    if not fits:
        others = [r["label"] for r in head[room - 1 :]][:NAMED]
        more = counts.count() - len(own) > NAMED
        legend[SLOTS - 1] = f"Other ({', '.join([*others, *(['…'] if more else [])])})"
    kind = values.schema["value"].dataType.simpleString()
    slots = values.sparkSession.createDataFrame([(r["value"], FIRST + i) for i, r in enumerate(own)], f"value {kind}, slot int")
    return counts.join(F.broadcast(slots), "value", "left").select("value", F.coalesce("slot", F.lit(SLOTS - 1)).alias("slot")), legend


def integer_scale(values: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """((value, slot), legend) of integers in their order: a slot each up to BUCKETS of them, else buckets of one round width.

    The width is the range's share rounded up to a multiple of its power of ten. values: key, value; nulls are left out.
    """
    held = values.where(F.col("value").isNotNull()).select(F.col("value").cast("long").alias("value")).distinct()
    few = [r["value"] for r in held.orderBy("value").limit(BUCKETS + 1).collect()]
    if len(few) <= BUCKETS:
        made = values.sparkSession.createDataFrame([(v, FIRST + i) for i, v in enumerate(few)], "value long, slot int")
        return made, {FIRST + i: str(v) for i, v in enumerate(few)}
    low, high = held.agg(F.min("value"), F.max("value")).first()
    share, power = (high - low) / BUCKETS, 1
    while share >= 10 * power:
        power *= 10
    width = -int(-share // power) * power
    n = -(-(high - low + 1) // width)
    legend = {FIRST + i: str(low + i) if width == 1 else f"{low + i * width}-{low + (i + 1) * width - 1}" for i in range(n)}
    return held.withColumn("slot", (FIRST + F.least(F.floor((F.col("value") - low) / width), F.lit(n - 1))).cast("int")), legend


def categories(points: DataFrame, values: DataFrame, scale: DataFrame) -> DataFrame:
    """(key, categories): each point's slots, ascending, one for each of its different values that has a slot; none gives an empty array."""
    named = values.select("key", "value").distinct().join(scale, "value").groupBy("key").agg(F.array_sort(F.collect_list("slot")).alias("categories"))
    return points.select("key").join(named, "key", "left").select("key", F.coalesce("categories", F.array().cast("array<int>")).alias("categories"))


def schema(legend: dict[int, str]) -> pa.Schema:
    """The stream's columns; the legend stands in its metadata."""
    columns = [("x", pa.float32()), ("y", pa.float32()), ("fulfils_filter", pa.uint8()), ("color_categories", pa.list_(pa.uint8())), ("sample_id", pa.string())]
    return pa.schema(columns, metadata={"color_legend": json.dumps({str(k): v for k, v in legend.items()})})


def messages(points: DataFrame, legend: dict[int, str], matching: DataFrame | None = None, coloured: DataFrame | None = None) -> DataFrame:
    """(part, at, message): an Arrow stream of a plot, cut into messages; in the order of part and at their bytes are the stream.

    points: key, x, y; matching: key of the points that pass the filter (None: all); coloured: key, categories.
    The first message is the schema with the legend and the last one ends the stream. Tasks encode a message per batch of points, so the
    stream never is in one place. Points without a place (null x or y) are left out.
    """
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("key", "x", "y")
    if matching is None:
        rows = rows.withColumn("passes", F.lit(1))
    else:
        rows = rows.join(matching.select("key").distinct().withColumn("passes", F.lit(1)), "key", "left").fillna(0, ["passes"])
    if coloured is None:
        rows = rows.withColumn("categories", F.array().cast("array<int>"))
    else:
        rows = rows.join(coloured.select("key", "categories"), "key", "left")
    rows = rows.select(F.col("x").cast("float"), F.col("y").cast("float"), F.col("passes").cast("int"), F.coalesce("categories", F.array().cast("array<int>")).alias("categories"), F.col("key").cast("string").alias("key"))
    shape = schema(legend)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, shape, strict=True)], schema=shape)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "at": pa.array([at], pa.int64()), "message": pa.array([made.serialize().to_pybytes()], pa.binary())})

    # Ends as Arrow writes them: the schema's message first, an empty message last.
    ends = [(-1, 0, bytearray(shape.serialize().to_pybytes())), ((1 << 62), 0, bytearray(b"\xff\xff\xff\xff\x00\x00\x00\x00"))]
    fixed = points.sparkSession.createDataFrame(ends, "part long, at long, message binary")
    return fixed.unionByName(rows.mapInArrow(run, "part long, at long, message binary"))


def stream(sent: DataFrame) -> Iterator[bytes]:
    """The messages' bytes in order, for a client to read; the driver holds those of one partition at a time."""
    for row in sent.orderBy("part", "at").select("message").toLocalIterator():
        yield bytes(row["message"])

