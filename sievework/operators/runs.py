"""Evaluation runs: one call for boxes, classes and masks, and the tables that keep their results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import evaluate

#: The kind of annotations that a task compares.
KINDS = {"object_detection": "object_detection", "classification": "classification", "semantic_segmentation": "segmentation_mask"}


@dataclass
class Run:
    """runs: one row (dataset, name, truth, predicted, task, config); sample_metrics: (dataset, run, sample, metric, value); pair_metrics: (dataset, run, sample, gt_id, pred_id, metric, value)."""

    runs: DataFrame
    sample_metrics: DataFrame
    pair_metrics: DataFrame


def evaluate_run(task: str, name: str, dataset: str, truth: str, predicted: str, samples: DataFrame, annotations: DataFrame, coverage: DataFrame, runs: DataFrame, **config) -> Run:
    """A run of a task over the samples that both sources cover.

    samples: sample; annotations: sample, id, source, kind, label and what the task needs (boxes: x, y, width, height,
    confidence; classes: confidence; masks: rle); coverage: source, sample; runs: the runs there are. config: threshold and by_class for
    boxes. Boxes give tp, fp and fn per sample and the IoU of each pair; classes give the disagreement,
    per sample and as the pair of both labels; masks give the mean IoU per sample and no pairs. Nothing is
    computed before the result is read; a wrong task, source or name fails at once.
    """
    if task not in KINDS:
        raise ValueError(f"no such task: {task}")
    if config and (task != "object_detection" or set(config) - {"threshold", "by_class"}):
        raise ValueError(f"settings that {task} does not have: {sorted(config)}")
    evaluate.check_run(annotations, runs, name, dataset, truth, predicted, KINDS[task])
    inside = evaluate.scope(samples, coverage, truth, predicted).select("sample")
    own = lambda source: annotations.where((F.col("source") == source) & (F.col("kind") == KINDS[task])).join(inside, "sample", "left_semi")
    gt, pred = own(truth), own(predicted)
    ids = annotations.schema["id"].dataType
    if task == "object_detection":
        config = {"threshold": 0.5, "by_class": True} | config
        pairs = evaluate.match_boxes(gt, pred, **config)
        counts = inside.join(evaluate.sample_counts(pairs), "sample", "left").na.fill(0, ["tp", "fp", "fn"])
        metrics = counts.select("sample", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("tp", "fp", "fn")])).alias("m")).select("sample", "m.metric", "m.value")
        pairs = pairs.select("sample", "gt_id", "pred_id", F.when(F.col("iou").isNotNull(), F.lit("iou")).alias("metric"), F.col("iou").alias("value"))
    elif task == "classification":
        scores = evaluate.disagreement(gt, pred)
        metrics = scores.select("sample", F.lit("disagreement").alias("metric"), F.col("disagreement").alias("value"))
        both = gt.select("sample", F.col("id").alias("gt_id")).join(pred.select("sample", F.col("id").alias("pred_id")), "sample")
        pairs = both.join(scores, "sample").select("sample", "gt_id", "pred_id", F.lit("disagreement").alias("metric"), F.col("disagreement").alias("value"))
    else:
        metrics = evaluate.mask_iou(gt, pred).select("sample", F.lit("miou").alias("metric"), F.col("miou").alias("value"))
        metrics = evaluate.require_masks(inside, gt, pred).join(metrics, "sample")
        pairs = inside.limit(0).select("sample", F.lit(None).cast(ids).alias("gt_id"), F.lit(None).cast(ids).alias("pred_id"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
    row = samples.sparkSession.createDataFrame([(dataset, name, truth, predicted, task, json.dumps(config, sort_keys=True))], "dataset string, name string, truth string, predicted string, task string, config string")
    named = lambda rows: rows.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("run"), *rows.columns)
    return Run(row, named(metrics), named(pairs))


def keep(run: Run, folder: str) -> None:
    """Adds a run's tables to those below `folder`, its row last: a run that is listed is whole.

    What a failed attempt left under the same name is overwritten, as each run has a folder of its own.
    """
    (row,) = run.runs.collect()
    own = f"dataset={row['dataset']}/run={row['name']}"
    run.sample_metrics.drop("dataset", "run").write.mode("overwrite").parquet(f"{folder}/sample_metrics/{own}")
    run.pair_metrics.drop("dataset", "run").write.mode("overwrite").parquet(f"{folder}/pair_metrics/{own}")
    run.runs.write.mode("append").parquet(f"{folder}/runs")


def kept(spark: SparkSession, folder: str) -> Run:
    """All runs below `folder` with their metrics; metrics of a run that is not listed are left out."""
    runs = spark.read.parquet(f"{folder}/runs")
    listed = runs.select("dataset", F.col("name").alias("run"))
    types = {"dataset": "string", "run": "string"}
    read = lambda name: spark.read.parquet(f"{folder}/{name}").withColumns({c: F.col(c).cast(t) for c, t in types.items()}).join(listed, ["dataset", "run"], "left_semi")
    return Run(runs, read("sample_metrics"), read("pair_metrics"))
