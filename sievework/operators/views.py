"""Views for display: rows with what hangs on them, and lookups that keep an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """`rows` with a sorted array column per kind of child, empty where there is none.

    children: name = (table with the key, its columns to show). One value per child is shown as it is,
    several as a struct. Each kind is grouped by the key before it is joined, so kinds do not multiply.
    """
    for name, (table, columns) in children.items():
        item = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
        held = table.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(item)).alias("__c"))
        joined = rows.join(held, F.col(key) == F.col("__k"), "left")
        kind = dict(held.dtypes)["__c"]
        rows = joined.withColumn(name, F.coalesce("__c", F.array().cast(kind))).drop("__k", "__c")
    return rows


def with_payload(annotations: DataFrame, parent: str, *payloads: tuple[str, DataFrame, str, list[str]]) -> DataFrame:
    """`annotations` with `payload`, a struct of its parent's kind, path and further columns.

    payloads: (kind, table, its key, columns), the first of which is the path. An annotation has one
    parent, in one of the tables; an annotation without any has a null payload.
    """
    names = list(dict.fromkeys(c for _, _, _, columns in payloads for c in columns))
    tables = []
    for kind, table, key, columns in payloads:
        fields = [F.col(c).cast("string").alias(c) if c in columns else F.lit(None).cast("string").alias(c) for c in names]
        tables.append(table.select(F.col(key).alias("__p"), F.struct(F.lit(kind).alias("kind"), *fields).alias("payload")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return annotations.join(every, F.col(parent) == F.col("__p"), "left").drop("__p")


def listed(annotations: DataFrame, parent: str, image_paths: DataFrame, video_paths: DataFrame) -> DataFrame:
    """`annotations` with `path`, that of its image or of its frame's video, else the empty string.

    Both tables: (parent, path). Sort by path, created_at and id for the order of a list.
    """
    a = image_paths.select(F.col("parent").alias("__i"), F.col("path").alias("__ip"))
    b = video_paths.select(F.col("parent").alias("__v"), F.col("path").alias("__vp"))
    joined = annotations.join(a, F.col(parent) == F.col("__i"), "left").join(b, F.col(parent) == F.col("__v"), "left")
    return joined.withColumn("path", F.coalesce("__ip", "__vp", F.lit(""))).drop("__i", "__ip", "__v", "__vp")


def in_given_order(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`rows` of the ids (id, place), with the place; ids without a row are skipped, a repeated id repeats its row."""
    return ids.join(rows, F.col("id") == F.col(key)).drop("id")


def names_by_id(ids: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """(id, names): the sorted names of each id, none where it has none."""
    held = names.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_set(name)).alias("__n"))
    return ids.join(held, F.col("id") == F.col("__k"), "left").select("id", F.coalesce("__n", F.array().cast("array<string>")).alias("names"))


def paths_with_total(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """(path, total): the paths of a filtered table in order, each with the number of all."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.select(path, *order).join(F.broadcast(total)).orderBy(*order).select(F.col(path).alias("path"), "total")
