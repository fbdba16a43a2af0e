"""Sorting, pages, neighbours in an order, and numbering of children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(rows: DataFrame, keys: list[tuple[str, bool]], tiebreak: str) -> list[Column]:
    """Sort columns: (name, descending) each with nulls last, then the unique tiebreak in the first key's direction."""
    down = bool(keys) and keys[0][1]
    return [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in keys] + [F.desc(tiebreak) if down else F.asc(tiebreak)]


def page(rows: DataFrame, keys: list[tuple[str, bool]], tiebreak: str, start: int, stop: int) -> DataFrame:
    """Rows start to stop of the order; none if stop does not exceed start."""
    if start < 0 or stop < 0:
        raise ValueError("a page has no negative bounds")
    return rows.orderBy(*ordered(rows, keys, tiebreak)).offset(start).limit(max(stop - start, 0))


def page_with_total(rows: DataFrame, keys: list[tuple[str, bool]], tiebreak: str, start: int, stop: int) -> DataFrame:
    """The page, each row with the count of all rows; the count runs before any sort."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, keys, tiebreak, start, stop).join(F.broadcast(total))  # total: one row


def neighbours(rows: DataFrame, keys: list[str], anchor: dict) -> DataFrame:
    """(previous, following, position, total) of one anchor row by seeking, without a global sort.

    `keys`: ascending non-null sort columns, the last one unique; `anchor`: their values. Each side is
    a filter and a top-1, the position a count.
    """

    def beyond(sign: str) -> Column:
        tests = []
        for i, k in enumerate(keys):
            equal = reduce(lambda a, b: a & b, [F.col(p) == F.lit(anchor[p]) for p in keys[:i]], F.lit(True))
            tests.append(equal & (F.col(k) < F.lit(anchor[k]) if sign == "<" else F.col(k) > F.lit(anchor[k])))
        return reduce(lambda a, b: a | b, tests)

    key = F.struct(*keys)
    return rows.agg(
        F.max(F.when(beyond("<"), key))[keys[-1]].alias("previous"),
        F.min(F.when(beyond(">"), key))[keys[-1]].alias("following"),
        (F.count(F.when(beyond("<"), 1)) + 1).alias("position"),
        F.count("*").alias("total"),
    )


def neighbours_within(rows: DataFrame, group: str, keys: list[str], key: str) -> DataFrame:
    """(key, previous, following, position) of every row within its group's order."""
    w = Window.partitionBy(group).orderBy(*keys)
    return rows.select(key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("following"), F.row_number().over(w).alias("position"))


def first_child(children: DataFrame, parent: str, order: str, *columns: str) -> DataFrame:
    """Each parent's first child by `order`, as an aggregate: no sort, no join."""
    return children.groupBy(parent).agg(F.min_by(F.struct(order, *columns), order).alias("c")).select(parent, "c.*")


def chunks(children: DataFrame, parent: str, order: str, size: int) -> DataFrame:
    """Children with chunk, their number's quotient by `size` in the parent's order; an unfilled last chunk goes."""
    if size < 2:
        raise ValueError("a sequence has at least two children")
    place = F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1
    held = F.count("*").over(Window.partitionBy(parent))
    numbered = children.withColumn("__p", place).withColumn("__n", held)
    return numbered.where(F.col("__p") < F.col("__n") - F.col("__n") % size).withColumn("chunk", F.floor(F.col("__p") / size).cast("int")).drop("__p", "__n")


def keeps_frame(index: Column, from_fps: float, to_fps: float) -> Column:
    """Whether a frame stays when a video is thinned from one rate to another."""
    step = lambda i: F.floor(i * to_fps / from_fps)
    return (index == 0) | (step(index) != step(index - 1))


def by_metric(rows: DataFrame, metrics: DataFrame, key: str, run, metric: str, descending: bool = False) -> DataFrame:
    """`rows` with metric_value, ordered by one run's metric; those without it come last either way, ties by key.

    metrics: sample, run, metric, value. Its rows are chosen before the outer join, so none of `rows` goes.
    """
    chosen = metrics.where((F.col("run") == F.lit(run)) & (F.col("metric") == metric)).select(F.col("sample").alias("__s"), F.col("value").alias("metric_value"))
    joined = rows.join(chosen, F.col(key) == F.col("__s"), "left").drop("__s")
    first = F.col("metric_value")
    return joined.orderBy(first.desc_nulls_last() if descending else first.asc_nulls_last(), F.desc(key) if descending else F.asc(key))


def pair_metric(annotations: DataFrame, pairs: DataFrame, key: str, side: str) -> DataFrame:
    """`annotations` with pair_value: that of its pair, 0 where the run left it unpaired, null where the run lacks it.

    pairs: gt_id, pred_id, value; `side` is gt_id or pred_id, the one that holds these annotations.
    """
    if side not in ("gt_id", "pred_id"):
        raise ValueError("the annotations are on neither side of the run")
    value = pairs.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("__a")).agg(F.max(F.coalesce("value", F.lit(0.0))).alias("pair_value"))
    return annotations.join(value, F.col(key) == F.col("__a"), "left").drop("__a")


def neighbours_of(rows: DataFrame, keys: list[str], anchors: DataFrame) -> DataFrame:
    """The anchors (columns `keys`, the last unique) with previous and following of the whole order.

    Rows are cut into ranges of the order; a range's first and last rows stand for it when its
    neighbours look beyond their own range, so no task sees all rows.
    """
    from sievework.operators.scratch import cut

    last = keys[-1]
    placed = rows.select(*keys).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    placed = cut(placed)
    own = Window.partitionBy("__p").orderBy(*keys)
    inside = placed.withColumns({"__a": F.lag(last).over(own), "__b": F.lead(last).over(own)})
    ends = placed.groupBy("__p").agg(F.min(F.struct(*keys))[last].alias("low"), F.max(F.struct(*keys))[last].alias("high"))  # a row per range
    ranges = Window.orderBy("__p")
    beyond = ends.select("__p", F.lag("high").over(ranges).alias("__c"), F.lead("low").over(ranges).alias("__d"))
    joined = inside.join(anchors.select(*keys), keys, "left_semi").join(F.broadcast(beyond), "__p")
    return joined.select(*keys, F.coalesce("__a", "__c").alias("previous"), F.coalesce("__b", "__d").alias("following"))


def random_rows(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows at random; the same seed takes the same rows, however they are spread."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def cursor(page: DataFrame, keys: list[str]) -> dict | None:
    """The values of the last row of a page, from which the next one goes on; None for an empty page."""
    held = page.agg(F.max(F.struct(*keys)).alias("k")).first()["k"]
    return None if held is None else held.asDict()


def after(rows: DataFrame, keys: list[str], at: dict | None, size: int) -> DataFrame:
    """The next `size` rows of an ascending order after a cursor, the first ones without one."""
    if at is not None:
        test = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(p) == F.lit(at[p]) for p in keys[:i]], F.lit(True)) & (F.col(k) > F.lit(at[k])) for i, k in enumerate(keys)])
        rows = rows.where(test)
    return rows.orderBy(*keys).limit(size)
