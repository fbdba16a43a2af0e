"""Predictions against ground truth: boxes, classes, masks, confusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.vectors import box_iou
from sievework.operators.scratch import cut

#: Boxes of a side that are matched in arrays.
GROUP = 256
BOX = ["x", "y", "width", "height"]
#: How the margins of a confusion matrix are called.
NO_TRUTH, NO_PREDICTION = "(no ground truth)", "(no prediction)"


def match_boxes(truth: DataFrame, predicted: DataFrame, threshold: float = 0.5, by_class: bool = True) -> DataFrame:
    """Pairing rows (sample, gt_id, pred_id, iou) of a greedy match per sample (and class).

    Both inputs: sample, id, label, x, y, width, height; `predicted` also confidence. Predictions go
    by confidence, highest first (null as 0), then by id; each takes the free box of highest IoU of at
    least `threshold` (above 0), the lowest id on ties. What stays free has a row with one null side and null iou.
    Boxes of a null sample (or, by class, label) match none.

    Groups of up to GROUP boxes a side are matched in arrays. Larger ones are never listed: boxes meet over a
    grid, and rounds fix the pairs that are each other's best. Where most boxes of a large sample
    lie on top of each other, the overlapping pairs grow with their square.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    keys = ["sample", "label"] if by_class else ["sample"]
    placed = F.lit(True)
    for c in keys:
        placed = placed & F.col(c).isNotNull()
    gt, pred = truth.select(*keys, "id", *BOX), predicted.select(*keys, "id", *BOX, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    alone = gt.where(~placed).select("sample", F.col("id").alias("gt_id"), F.lit(None).cast(pred.schema["id"].dataType).alias("pred_id"), F.lit(None).cast("double").alias("iou"))
    alone = alone.unionByName(pred.where(~placed).select("sample", F.lit(None).cast(gt.schema["id"].dataType).alias("gt_id"), F.col("id").alias("pred_id"), F.lit(None).cast("double").alias("iou")))
    gt, pred = gt.where(placed), pred.where(placed)
    sides = gt.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    large = cut(sides.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p")).where((F.col("g") > GROUP) | (F.col("p") > GROUP)).select(*keys))
    if large.isEmpty():
        return _match_lists(gt, pred, keys, threshold).unionByName(alone)
    small = lambda rows: rows.join(large, keys, "left_anti")
    own = lambda rows: rows.join(large, keys, "left_semi")
    return _match_lists(small(gt), small(pred), keys, threshold).unionByName(_match_rounds(own(gt), own(pred), keys, threshold)).unionByName(alone)


def _match_lists(gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The greedy match of groups that fit an array: predictions in their order, each against the boxes that are free.

    Both sides are sorted by group within a task, and all groups of an Arrow batch are matched together, turn by turn.
    """
    ids, others = gt.schema["id"].dataType.simpleString(), pred.schema["id"].dataType.simpleString()
    one = lambda rows, side, order, g, p: rows.select(*keys, F.lit(side).alias("side"), order.alias("order"), g.cast(ids).alias("gt_id"), p.cast(others).alias("pred_id"), *BOX)
    both = one(gt, 0, F.lit(0.0), F.col("id"), F.lit(None)).unionByName(one(pred, 1, -F.col("confidence"), F.lit(None), F.col("id")))
    rows = both.repartition(*keys).sortWithinPartitions(*keys, "side", "order", "gt_id", "pred_id", *BOX)

    def match(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            starts = _group_starts(held, keys)
            if starts[-1]:  # the last group may go on in the next batch
                yield from _matched(held.slice(0, starts[-1]), starts[:-1], threshold).to_batches()
                held = held.slice(starts[-1])
        if held is not None:
            yield from _matched(held, np.zeros(1, np.int64), threshold).to_batches()

    return rows.mapInArrow(match, f"sample {gt.schema['sample'].dataType.simpleString()}, gt_id {ids}, pred_id {others}, iou double")


def _group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a group of equal keys starts; a NaN is like another, as in a grouping."""
    new = np.zeros(len(rows) - 1, bool)
    for c in keys:
        column = rows.column(c)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            new |= np.array([x != y for x, y in zip(values[1:], values, strict=False)], bool)
            continue
        a, b = column.slice(1), column.slice(0, len(rows) - 1)
        other = pc.not_equal(a, b)
        if pa.types.is_floating(column.type):
            other = pc.and_not(other, pc.and_(pc.is_nan(a), pc.is_nan(b)))
        new |= other.to_numpy()
    return np.r_[0, np.flatnonzero(new) + 1]


def _matched(rows: pa.Table, starts: np.ndarray, threshold: float) -> pa.Table:
    """Pairing rows of whole groups, each with its boxes before its predictions, both in their order."""
    n, predicted = len(rows), rows.column("side").to_numpy() == 1
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    boxes = np.bincount(group[~predicted], minlength=len(starts))
    asked = np.flatnonzero(predicted)
    times = boxes[group[asked]]
    p = np.repeat(asked, times)
    g = starts[group[p]] + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)
    sides = {c: rows.column(c).to_numpy() for c in BOX}
    sides = {c: v if v.dtype.kind == "f" else v.astype(np.int64 if v.dtype.kind in "iu" else np.float64) for c, v in sides.items()}

    def shared(at, side):
        low, high = sides[at], sides[at] + sides[side]
        return np.maximum(np.minimum(high[g], high[p]) - np.maximum(low[g], low[p]), 0).astype(np.float64)

    both = shared("x", "width") * shared("y", "height")
    area = sides["width"].astype(np.float64) * sides["height"].astype(np.float64)
    union = area[g] + area[p] - both
    iou = np.divide(both, union, out=np.zeros(len(p)), where=union > 0)
    kept = np.flatnonzero(iou >= threshold)
    p, g, iou = p[kept], g[kept], iou[kept]
    turn = p - starts[group[p]] - boxes[group[p]]
    order = np.lexsort((g, -iou, p, turn))
    p, g, iou, turn = p[order], g[order], iou[order], turn[order]
    free, picks = np.ones(n, bool), [np.empty(0, np.int64)]
    for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(turn)) + 1):  # a prediction of each group at a time
        part = part[free[g[part]]]
        part = part[np.r_[True, p[part][1:] != p[part][:-1]]] if len(part) else part  # its best that is free
        free[g[part]] = False
        picks.append(part)
    pick = np.concatenate(picks)
    free[p[pick]] = False
    alone = np.flatnonzero(free)
    at = np.r_[p[pick], alone]
    gt_row = np.r_[g[pick], alone]
    return pa.table({
        "sample": rows.column("sample").take(pa.array(at)), "gt_id": rows.column("gt_id").take(pa.array(gt_row)), "pred_id": rows.column("pred_id").take(pa.array(at)),
        "iou": pa.array(np.r_[iou[pick], np.zeros(len(alone))], mask=np.arange(len(at)) >= len(pick)),
    })


def _cells(rows: DataFrame, threshold: float, spread: bool) -> DataFrame:
    """Rows with the cells of a grid, whose sizes follow the boxes' own sides (`level` x, y), that they must meet in.

    Two boxes of an IoU of at least t have sides that differ by a factor of at most 1 / t, and centres at most
    (1 - t) / t of either side apart. A box stands in the cell of its own size (by powers of two) that holds its
    centre; with `spread` it stands in all cells, of all sizes, that a partner's centre can lie in.
    """
    import math

    level = lambda side: F.floor(F.log2(F.greatest(F.col(side).cast("double"), F.lit(1e-9))))
    centre = lambda at, side: F.col(at) + F.col(side) / 2
    made = rows
    for at, side in (("x", "width"), ("y", "height")):
        if not spread:
            made = made.withColumn(f"level_{at}", level(side)).withColumn(f"cell_{at}", F.floor(centre(at, side) / F.pow(F.lit(2.0), F.col(f"level_{at}"))))
            continue
        steps = math.ceil(math.log2(1 / threshold)) + 1
        made = made.withColumn(f"level_{at}", F.explode(F.sequence(level(side) - steps, level(side) + steps)))
        reach, size = F.col(side) * ((1 - threshold) / threshold) * (1 + 1e-9) + 1e-9, F.pow(F.lit(2.0), F.col(f"level_{at}"))
        made = made.withColumn(f"cell_{at}", F.explode(F.sequence(F.floor((centre(at, side) - reach) / size), F.floor((centre(at, side) + reach) / size))))
    return made


def _match_rounds(gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The greedy match of groups of any size, by rounds over the pairs of boxes that overlap enough.

    A round fixes each pair of which the prediction comes first of all that still overlap the box, and the
    box is the prediction's best that is left; what touches a fixed pair goes. The first prediction left
    is always in such a pair, so rounds end, and the result is that of the greedy order.
    """
    ids, others = gt.schema["id"].dataType, pred.schema["id"].dataType
    copies = lambda rows: rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")  # noqa: E731  repeated rows are boxes each
    gt, pred = cut(copies(gt).withColumn("g", F.struct("id", *BOX, "copy"))), cut(copies(pred).withColumn("p", F.struct((-F.col("confidence")).alias("order"), "id", *BOX, "copy")))
    grid = [*keys, "level_x", "level_y", "cell_x", "cell_y"]
    met = _cells(gt, threshold, True).select(*grid, "g").join(_cells(pred, threshold, False).select(*grid, "p"), grid)
    pairs = cut(met.withColumn("iou", box_iou(F.col("g"), F.col("p"))).where(F.col("iou") >= threshold).select(*keys, "g", "p", "iou"))
    fixed = None
    while not pairs.isEmpty():
        first = pairs.withColumns({
            "best": F.row_number().over(Window.partitionBy(*keys, "p").orderBy(F.desc("iou"), "g")),
            "turn": F.row_number().over(Window.partitionBy(*keys, "g").orderBy("p")),
        }).where("best = 1 AND turn = 1").select(*keys, "g", "p", "iou")
        first = cut(first)
        fixed = first if fixed is None else fixed.unionByName(first)
        pairs = cut(pairs.join(first.select(*keys, "g"), [*keys, "g"], "left_anti").join(first.select(*keys, "p"), [*keys, "p"], "left_anti"))
    side = lambda name, kind: F.col(f"{name}.id").cast(kind)
    null = lambda kind: F.lit(None).cast(kind)
    if fixed is None:
        return gt.select("sample", side("g", ids).alias("gt_id"), null(others).alias("pred_id"), null("double").alias("iou")).unionByName(pred.select("sample", null(ids).alias("gt_id"), side("p", others).alias("pred_id"), null("double").alias("iou")))
    fixed = cut(fixed)
    left = gt.join(fixed.select(*keys, "g"), [*keys, "g"], "left_anti").select("sample", side("g", ids).alias("gt_id"), null(others).alias("pred_id"), null("double").alias("iou"))
    right = pred.join(fixed.select(*keys, "p"), [*keys, "p"], "left_anti").select("sample", null(ids).alias("gt_id"), side("p", others).alias("pred_id"), null("double").alias("iou"))
    return fixed.select("sample", side("g", ids).alias("gt_id"), side("p", others).alias("pred_id"), "iou").unionByName(left).unionByName(right)


def sample_counts(pairs: DataFrame) -> DataFrame:
    """(sample, tp, fp, fn) from pairing rows."""
    n = lambda test: F.sum(test.cast("long"))
    gt, pred = F.col("gt_id").isNotNull(), F.col("pred_id").isNotNull()
    return pairs.groupBy("sample").agg(n(gt & pred).alias("tp"), n(~gt & pred).alias("fp"), n(gt & ~pred).alias("fn"))


def disagreement(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sample, disagreement) of single-label samples: 1 - confidence where labels agree, else the confidence (null: 1).

    A sample of either side must have exactly one row on each; any other fails the job with its name.
    """
    one = lambda rows, side: rows.select("sample", F.struct(F.lit(side).alias("side"), "label", (F.col("confidence") if side else F.lit(None).cast("double")).alias("confidence")).alias("r"))
    both = one(truth, 0).unionByName(one(predicted, 1)).groupBy("sample").agg(
        F.count(F.when(F.col("r.side") == 0, 1)).alias("n_gt"), F.count(F.when(F.col("r.side") == 1, 1)).alias("n_pred"), F.min("r").alias("gt"), F.max("r").alias("pred")
    )
    wrong = (F.col("n_gt") != 1) | (F.col("n_pred") != 1)
    c = F.coalesce("pred.confidence", F.lit(1.0))
    value = F.when(F.col("gt.label") == F.col("pred.label"), 1 - c).otherwise(c)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not one true and one predicted label: sample "), F.col("sample").cast("string"))).cast("double")).otherwise(value)
    return both.select("sample", checked.alias("disagreement"))


def check_run(annotations: DataFrame, runs: DataFrame, name: str, dataset, truth: str, predicted: str, kind: str) -> None:
    """Fails unless a run may be made: two different sources, both with annotations of the task's kind alone, a name new to the dataset.

    annotations: source, kind; runs: dataset, name.
    """
    if truth == predicted:
        raise ValueError("truth and prediction are the same source")
    found = annotations.where(F.col("source").isin(truth, predicted)).groupBy("source").agg(F.bool_and(F.col("kind") == kind).alias("fits")).collect()
    fits = {r["source"]: r["fits"] for r in found}
    for source in (truth, predicted):
        if not fits.get(source, False):
            raise ValueError(f"{source} must hold {kind} annotations and no others")
    if not runs.where((F.col("dataset") == F.lit(dataset)) & (F.col("name") == name)).limit(1).isEmpty():
        raise ValueError(f"the dataset has a run named {name} already")


def scope(samples: DataFrame, coverage: DataFrame, truth: str, predicted: str, key: str = "sample") -> DataFrame:
    """Samples that both sources cover, with annotations or without. coverage: source, sample."""
    for source in (truth, predicted):
        samples = samples.join(coverage.where(F.col("source") == source).select(F.col("sample").alias(key)), key, "left_semi")
    return samples


def labelled_pairs(pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """`pairs` (gt_id, pred_id) with gt_label and pred_label, null on an absent side; annotations: id, label."""
    for side in ("gt", "pred"):
        names = annotations.select(F.col("id").alias(f"__{side}"), F.col("label").alias(f"{side}_label"))
        pairs = pairs.join(names, F.col(f"{side}_id") == F.col(f"__{side}"), "left").drop(f"__{side}")
    return pairs


def evaluate_boxes(samples: DataFrame, annotations: DataFrame, coverage: DataFrame, truth: str, predicted: str, threshold: float = 0.5, by_class: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs with labels, counts per sample) of one run over the samples that both sources cover.

    A covered sample without boxes on either side has counts of zero.
    """
    inside = scope(samples, coverage, truth, predicted)
    own = lambda source: annotations.where(F.col("source") == source).join(inside.select("sample"), "sample", "left_semi")
    pairs = labelled_pairs(match_boxes(own(truth), own(predicted), threshold, by_class), annotations)
    counts = inside.select("sample").join(sample_counts(pairs), "sample", "left").na.fill(0, ["tp", "fp", "fn"])
    return pairs, counts


def summary(samples: DataFrame, annotations: DataFrame, coverage: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (samples, truths, predictions): what a run is about."""
    inside = scope(samples, coverage, truth, predicted).select("sample")
    kept = annotations.join(inside, "sample", "left_semi")
    counts = kept.agg(F.count(F.when(F.col("source") == truth, 1)).alias("truths"), F.count(F.when(F.col("source") == predicted, 1)).alias("predictions"))
    return inside.agg(F.count("*").alias("samples")).join(F.broadcast(counts))  # one row each


def metric_bounds(metrics: DataFrame) -> DataFrame:
    """(run, metric, low, high) of sample metrics."""
    return metrics.groupBy("run", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def metric_names(runs: DataFrame, pair_metrics: DataFrame, source: str) -> DataFrame:
    """(run, metric): the metrics of pairs in the runs that a source takes part in, each once. runs: run, truth, predicted."""
    own = runs.where((F.col("truth") == source) | (F.col("predicted") == source)).select("run")
    # The few different metrics first, so that only they meet the runs and no run's rows come together.
    return pair_metrics.where(F.col("metric").isNotNull()).select("run", "metric").distinct().join(own, "run", "left_semi")


def confusion(pairs: DataFrame, gt: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """(gt_label, pred_label, n) over all labels on both axes, zeros and both margins included; empty without pairs."""
    named = pairs.select(F.coalesce(gt, F.lit(NO_TRUTH)).alias("gt_label"), F.coalesce(pred, F.lit(NO_PREDICTION)).alias("pred_label"))
    counts = named.groupBy("gt_label", "pred_label").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("gt_label", "pred_label")).alias("l")).where(~F.col("l").isin(NO_TRUTH, NO_PREDICTION)).distinct()
    held = labels.agg(F.collect_set("l").alias("ls"), F.count("*").alias("k"))  # labels are a small dimension
    some = counts.limit(1).select(F.lit(1).alias("some"))
    axes = held.join(F.broadcast(some)).select(F.explode(F.concat("ls", F.array(F.lit(NO_TRUTH)))).alias("gt_label"), "ls")
    axes = axes.select("gt_label", F.explode(F.concat("ls", F.array(F.lit(NO_PREDICTION)))).alias("pred_label"))
    return axes.join(counts, ["gt_label", "pred_label"], "left").select("gt_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def mask_iou(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sample, miou): mean over classes of the IoU of run-length masks.

    Inputs: sample, label, rle (row-wise runs, the first of zeros). A class's masks are joined; runs
    become intervals of set pixels, and boundaries where either side changes split them, so no bitmap
    is made. A class that both sides lack does not count; two empty masks have IoU 1. A sample whose
    masks differ in size fails the job. A sample without any mask has no row: see `require_masks`.
    """

    def spans(rows: DataFrame, side: str) -> DataFrame:
        runs = rows.select("sample", "label", F.posexplode("rle").alias("i", "run"), "rle")
        start = F.aggregate(F.slice("rle", 1, F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x)
        ones = runs.where("i % 2 = 1 AND run > 0").select("sample", "label", start.alias("a"), (start + F.col("run")).alias("b"))
        return ones.select("sample", "label", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("e")).select("sample", "label", "e.at", F.lit(side).alias("side"), "e.d")

    events = spans(truth, "g").unionByName(spans(predicted, "p"))
    delta = lambda s: F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0))
    steps = events.groupBy("sample", "label", "at").agg(delta("g").alias("g"), delta("p").alias("p"))
    w = Window.partitionBy("sample", "label").orderBy("at")
    on = steps.select("sample", "label", (F.sum("g").over(w) > 0).alias("g"), (F.sum("p").over(w) > 0).alias("p"), (F.coalesce(F.lead("at").over(w), F.col("at")) - F.col("at")).alias("n"))
    sizes = on.groupBy("sample", "label").agg(F.sum(F.when(F.col("g") & F.col("p"), F.col("n")).otherwise(0)).alias("both"), F.sum(F.when(F.col("g") | F.col("p"), F.col("n")).otherwise(0)).alias("any"))
    pixels = F.aggregate("rle", F.lit(0).cast("long"), lambda s, x: s + x)
    every = truth.select("sample", "label", pixels.alias("size")).unionByName(predicted.select("sample", "label", pixels.alias("size")))
    shapes = every.groupBy("sample").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    present = every.select("sample", "label").distinct().join(shapes, "sample")
    iou = F.when(F.coalesce("any", F.lit(0)) > 0, F.col("both") / F.col("any")).otherwise(1.0)
    value = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("masks of different sizes: sample "), F.col("sample").cast("string"))).cast("double")).otherwise(iou)
    return present.join(sizes, ["sample", "label"], "left").groupBy("sample").agg(F.avg(value).alias("miou"))


def require_masks(samples: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """`samples`, failing the job for one without a mask on either side, which has no IoU."""
    held = truth.select("sample").unionByName(predicted.select("sample")).distinct().withColumn("__m", F.lit(True))
    checked = F.when(F.col("__m").isNull(), F.raise_error(F.concat(F.lit("no mask on either side: sample "), F.col("sample").cast("string"))).cast("boolean")).otherwise(True)
    return samples.join(held, "sample", "left").where(checked).drop("__m")
