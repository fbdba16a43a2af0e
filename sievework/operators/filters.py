"""Filters as wholes: what a user sets in one place, applied as filters and semi-joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import all_of, in_range


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is the first column of `ids`."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


@dataclass
class AnnotationsFilter:
    """Criteria on annotations; each that is set must hold.

    Columns of an annotation: id, parent, kind, source, label. `tags`: names, any of which must be linked
    to the annotation in `links` (id, tag). `ids` and `region`: tables of annotation ids; an empty region
    leaves nothing, while an unset one does not count.
    """

    kinds: list = field(default_factory=list)
    sources: list = field(default_factory=list)
    labels: list = field(default_factory=list)
    tags: list = field(default_factory=list)
    links: DataFrame | None = None
    ids: DataFrame | None = None
    region: DataFrame | None = None

    def is_set(self) -> bool:
        return bool(self.kinds or self.sources or self.labels or self.tags) or self.ids is not None or self.region is not None

    def apply(self, annotations: DataFrame) -> DataFrame:
        """The annotations that pass; all of them where nothing is set."""
        lists = [("kind", self.kinds), ("source", self.sources), ("label", self.labels)]
        kept = annotations.where(all_of(*[F.col(c).isin(v) for c, v in lists if v]))
        if self.tags:
            if self.links is None:
                raise ValueError("tags need the table of links")
            kept = among(kept, "id", self.links.where(F.col("tag").isin(self.tags)).select("id"))
        for ids in (self.ids, self.region):
            if ids is not None:
                kept = among(kept, "id", ids)
        return kept

    def parents(self, annotations: DataFrame) -> DataFrame:
        """(parent) of the annotations that pass: where nothing is set, of all that there are."""
        return self.apply(annotations).select("parent").distinct()

    def apply_to_parents(self, samples: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
        """The samples with a passing annotation; where nothing is set, those with any annotation."""
        return among(samples, key, self.parents(annotations))


def frame_or_direct(videos: DataFrame, frames: DataFrame, annotations: DataFrame, wanted: AnnotationsFilter, key: str, frame: str, video: str) -> DataFrame:
    """Videos with a passing annotation of their own or on one of their frames.

    The two id sets are joined to one before the semi-join, so a video is probed once.
    """
    parents = wanted.parents(annotations)
    on_frames = among(frames, frame, parents).select(F.col(video).alias("parent"))
    return among(videos, key, parents.unionByName(on_frames).distinct())


@dataclass
class SampleFilter:
    """Criteria on samples, all of which must hold; what is None does not count.

    ids, region: tables of sample ids (an empty one leaves nothing). tags: names, any of which is linked
    in `links` (key, tag). annotations: a filter and the table it holds for. captioned: True asks for a
    caption in `captions` (key), False for none. cell: a table of sample ids from a confusion cell.
    ranges: inclusive bounds by column, either of them None. test: any condition on the row.
    """

    ids: DataFrame | None = None
    region: DataFrame | None = None
    tags: list = field(default_factory=list)
    links: DataFrame | None = None
    annotations: tuple[AnnotationsFilter, DataFrame] | None = None
    captioned: bool | None = None
    captions: DataFrame | None = None
    cell: DataFrame | None = None
    ranges: dict = field(default_factory=dict)
    test: Column | None = None

    def apply(self, samples: DataFrame, key: str) -> DataFrame:
        tests = [in_range(F.col(c), low, high) for c, (low, high) in self.ranges.items()]
        kept = samples.where(all_of(*tests, *([] if self.test is None else [self.test])))
        for ids in (self.ids, self.region, self.cell):
            if ids is not None:
                kept = among(kept, key, ids)
        if self.tags:
            kept = among(kept, key, self.links.where(F.col("tag").isin(self.tags)).select(key))
        if self.annotations is not None:
            wanted, table = self.annotations
            kept = wanted.apply_to_parents(kept, table, key)
        if self.captioned is not None:
            kept = kept.join(self.captions.select(key), key, "left_semi" if self.captioned else "left_anti")
        return kept

    def ids_of(self, samples: DataFrame, key: str) -> DataFrame:
        """(key) of the samples that pass, each once."""
        return self.apply(samples, key).select(key).distinct()


def confusion_cell(pairs: DataFrame, truth: str | None, prediction: str | None) -> DataFrame:
    """(sample) of the samples with a pair in one cell of a confusion matrix; None stands for a margin.

    pairs: sample, gt_label, pred_label, with null for an unpaired side. The cell of both margins does not exist.
    """
    if truth is None and prediction is None:
        raise ValueError("a cell has a true or a predicted label")
    return pairs.where(F.col("gt_label").eqNullSafe(F.lit(truth)) & F.col("pred_label").eqNullSafe(F.lit(prediction))).select("sample").distinct()


def metric_samples(runs: DataFrame, metrics: DataFrame, samples: DataFrame, run: str, criteria: list[tuple[str, str, float]]) -> DataFrame:
    """Samples that the named run of their own dataset measured, and whose metrics meet every criterion.

    runs: dataset, run, name; metrics: run, sample, metric, value; samples: sample, dataset. A criterion
    is (metric, operator, value), each met by a row of its own. One pass over the run's metrics: a flag
    per criterion is aggregated per sample before anything is joined.
    """
    compare = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}
    flags = [F.coalesce(F.bool_or((F.col("metric") == m) & compare[op](F.col("value"), F.lit(v))), F.lit(False)).alias(f"c{i}") for i, (m, op, v) in enumerate(criteria)]
    chosen = runs.where(F.col("name") == run).select("run", F.col("dataset").alias("of"))
    held = metrics.join(chosen, "run").groupBy("sample", "of").agg(F.count("*").alias("n"), *flags)
    met = held.where(all_of(*[F.col(f"c{i}") for i in range(len(criteria))])).select(F.col("sample").alias("s"), "of")
    return samples.join(met, (F.col("sample") == F.col("s")) & (F.col("dataset") == F.col("of")), "left_semi")


def pair_samples(pairs: DataFrame, kind: str, truth: str | None = None, prediction: str | None = None, criteria: list[Column] | None = None) -> DataFrame:
    """(sample) with a pair of one kind: confusion (both labels), false_positive (no truth), false_negative (no prediction).

    pairs: sample, gt_id, pred_id, gt_label, pred_label, metric, value, a row per metric of a pair. For a
    confusion each criterion must hold on some row of the same pair, an absent side equal to itself.
    """
    tests = {
        "confusion": (F.col("gt_label") == F.lit(truth)) & (F.col("pred_label") == F.lit(prediction)),
        "false_positive": F.col("gt_id").isNull() & (F.col("pred_label") == F.lit(prediction)),
        "false_negative": F.col("pred_id").isNull() & (F.col("gt_label") == F.lit(truth)),
    }
    if criteria and kind != "confusion":
        raise ValueError("only a confusion takes criteria")
    # Null is a value of its own in a grouping, so one aggregation per pair replaces self joins.
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{i}") for i, c in enumerate(criteria or [])]
    per_pair = pairs.where(tests[kind]).groupBy("sample", "gt_id", "pred_id").agg(F.count("*").alias("n"), *flags)
    return per_pair.where(all_of(*[F.col(f"c{i}") for i in range(len(flags))])).select("sample").distinct()
