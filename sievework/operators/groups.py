"""Groups of samples: a fixed list of component names, at most one sample for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(groups: DataFrame, members: DataFrame, names: list, group: str, component: str, sample: str) -> DataFrame:
    """Every group with a column for each name, null where it has no such sample; other names are left out."""
    held = members.where(F.col(component).isin(names)).groupBy(F.col(group).alias("__g"))
    wide = held.agg(*[F.max(F.when(F.col(component) == F.lit(n), F.col(sample))).alias(str(n)) for n in names])
    return groups.join(wide, F.col(group) == F.col("__g"), "left").drop("__g")


def previews(members: DataFrame, group: str, place: str, sample: str) -> DataFrame:
    """(group, preview): the sample of each group's lowest component, the least on ties."""
    return members.groupBy(group).agg(F.min(F.struct(place, sample)).getField(sample).alias("preview"))


def violations(members: DataFrame, names: list, group: str, component: str) -> DataFrame:
    """(group, component, n, known) of what a group may not hold: a name twice, or one not in the list."""
    known = F.coalesce(F.col(component).isin(names), F.lit(False))
    counts = members.groupBy(group, component).agg(F.count("*").alias("n")).withColumn("known", known)
    return counts.where((F.col("n") > 1) | ~F.col("known"))
