"""Counts, histograms and bounds that show what a filter leaves of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(children: DataFrame, label: str, parent: str, kept: DataFrame, distinct_parents: bool = False) -> DataFrame:
    """(label, current, total): children by label, of the parents in `kept` and of all; labels without any are left out."""
    n = F.count_distinct(parent) if distinct_parents else F.count("*")
    total = children.groupBy(label).agg(n.alias("total"))
    current = children.join(kept.select(parent).distinct(), parent, "left_semi").groupBy(label).agg(n.alias("current"))
    return total.join(current, label, "left").select(label, F.coalesce("current", F.lit(0)).alias("current"), "total")


def tag_grid(children: DataFrame, tag: str, label: str) -> DataFrame:
    """(tag, label, n) for every tag with every label, zeros included. Both axes are small dimensions."""
    axes = children.groupBy(tag).agg(F.lit(1).alias("__k")).select(tag).join(children.groupBy(label).agg(F.lit(1).alias("__k")).select(label))
    counts = children.groupBy(tag, label).agg(F.count("*").alias("n"))
    return axes.join(counts, [tag, label], "left").select(tag, label, F.coalesce("n", F.lit(0)).alias("n"))


def union_distinct_counts(label: str, parent: str, *children: DataFrame) -> DataFrame:
    """(label, n): distinct parents by label over the union of several kinds of children."""
    both = reduce(DataFrame.unionByName, [c.select(label, parent) for c in children])
    return both.groupBy(label).agg(F.count_distinct(parent).alias("n"))


def histogram(rows: DataFrame, value: Column, bins: int = 20, kept: Column | None = None) -> DataFrame:
    """(bin, n, low, high): equal bins between the bounds of all rows, counting the rows that `kept` passes.

    The last bin has its upper edge; with equal bounds there is one bin; nulls do not count; empty bins do.
    """
    values = rows.select(value.cast("double").alias("v"), (kept if kept is not None else F.lit(True)).alias("k")).where(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(0)), F.lit(bins - 1)))
    counts = values.join(F.broadcast(bounds)).where("k").groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # bounds: one row
    last = F.when(F.col("lo") == F.col("hi"), 0).otherwise(bins - 1)
    edges = bounds.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)
    return edges.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))


def top_values(rows: DataFrame, value: Column, limit: int = 20) -> DataFrame:
    """(value, n): the most frequent values, ties by value, nulls left out."""
    counts = rows.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def bounds(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of min and max per column."""
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def having_all_labels(children: DataFrame, parent: str, label: str, wanted: list) -> DataFrame:
    """Parents that have every wanted label among their children (relational division)."""
    held = children.where(F.col(label).isin(wanted)).groupBy(parent).agg(F.count_distinct(label).alias("n"))
    return held.where(F.col("n") == len(set(wanted))).select(parent)


def frequency_slots(rows: DataFrame, value: Column, key: str, first: int = 3, last: int = 255) -> DataFrame:
    """(key, slot): a colour slot per row by its value's frequency; values beyond the last slot share it."""
    named = rows.select(key, value.alias("__v"))
    ranked = named.where(F.col("__v").isNotNull()).groupBy("__v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__v").limit(last - first)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "__v")))  # at most last - first values
    slots = ranked.agg(order.alias("o")).select(F.posexplode("o").alias("at", "e")).select((F.col("at") + first).alias("slot"), F.col("e.__v").alias("__v"))
    return named.join(F.broadcast(slots), "__v", "left").select(key, F.when(F.col("__v").isNull(), 0).otherwise(F.coalesce("slot", F.lit(last))).alias("slot"))


def overview(roots: DataFrame, samples: DataFrame, key: str, collection: str) -> DataFrame:
    """`roots` with n_samples, 0 where none; samples are counted before the join."""
    counts = samples.groupBy(F.col(collection).alias("__c")).agg(F.count("*").alias("n_samples"))
    return roots.join(counts, F.col(key) == F.col("__c"), "left").drop("__c").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
