"""Few-shot classifiers on embeddings: train, predict, label a collection, ask for more labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.catalog import get_or_create


@dataclass
class FewShot:
    """A trained forest; `classes` in the order of its probabilities, `trained` those that had examples."""

    model: object
    classes: list[str]
    trained: list[str]


def train(examples: DataFrame, classes: list[str], label: str = "label", vector: str = "embedding", trees: int = 20, seed: int = 42) -> FewShot:
    """A random forest on labelled embeddings, classes weighted so that each counts the same.

    `classes` fixes the order of probabilities; some may have no examples, a label outside them fails.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    counts = {r[0]: r[1] for r in examples.groupBy(label).agg(F.count("*")).collect()}  # a row per class
    unknown = set(counts) - set(classes)
    if unknown or not counts:
        raise ValueError(f"examples of classes that are not listed: {sorted(map(str, unknown))}" if unknown else "no examples")
    trained = [c for c in classes if c in counts]
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for c in trained for x in (c, total / (len(trained) * counts[c]))])
    place = F.create_map(*[F.lit(x) for i, c in enumerate(trained) for x in (c, float(i))])
    rows = examples.select(place[F.col(label)].alias("y"), array_to_vector(F.col(vector).cast("array<double>")).alias("x"), weight[F.col(label)].alias("w"))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, seed=seed).fit(rows)
    return FewShot(model, list(classes), trained)


def predict(made: FewShot, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, probabilities): one per class in order, zero for a class without examples."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    scored = made.model.transform(rows).withColumn("p", vector_to_array("probability"))
    full = F.array(*[F.get("p", F.lit(made.trained.index(c))) if c in made.trained else F.lit(0.0) for c in made.classes])
    return scored.select(key, full.alias("probabilities"))


def annotate(made: FewShot, vectors: DataFrame, annotations: DataFrame, labels: DataFrame, source: str, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(annotations, labels) with a classification of every embedded sample by its likeliest class.

    annotations: sample, label, confidence, source; labels: id, name, in which missing classes are made.
    Earlier annotations of the source with one of the classes' labels are replaced; of equally likely
    classes the first wins.
    """
    spark = vectors.sparkSession
    grown = get_or_create(labels, spark.createDataFrame([(c,) for c in made.classes], "name string"), "name", "id")
    told = predict(made, vectors, key, vector)
    best = F.array_position("probabilities", F.array_max("probabilities"))
    named = told.select(F.col(key).alias("sample"), F.array(*map(F.lit, made.classes))[(best - 1).cast("int")].alias("name"), F.array_max("probabilities").alias("confidence"))
    new = named.join(grown, "name").select("sample", F.col("id").alias("label"), "confidence", F.lit(source).alias("source"))
    own = grown.where(F.col("name").isin(made.classes)).select(F.col("id").alias("label"))
    old = annotations.where(F.col("source") == source).join(own, "label", "left_semi").select("sample", "label", "confidence", "source")
    rest = annotations.select("sample", "label", "confidence", "source").exceptAll(old)
    return rest.unionByName(new), grown


def to_review(made: FewShot, vectors: DataFrame, used: DataFrame, n: int = 10, seed: int = 42, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, bucket): n random samples that are rather the first class (over 0.5) and n others, none of them used before.

    Randomness is a keyed hash, so the same seed asks for the same samples.
    """
    told = predict(made, vectors, key, vector).join(used.select(key), key, "left_anti")
    named = told.select(key, F.when(F.col("probabilities")[0] > 0.5, made.classes[0]).otherwise(made.classes[1]).alias("bucket"), F.xxhash64(F.lit(seed), key).alias("r"))
    parts = [named.where(F.col("bucket") == c).orderBy("r", key).limit(n) for c in made.classes[:2]]
    return parts[0].unionByName(parts[1]).select(key, "bucket")


def relabelled(examples: DataFrame, new: DataFrame, classes: list[str], key: str = "vec_id", label: str = "label") -> DataFrame:
    """Examples after new labels: a new one supersedes a sample's old ones; a class that is not listed fails."""
    known = F.coalesce(F.col(label).isin(classes), F.lit(False))
    checked = new.withColumn(label, F.when(known, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("no such class: "), F.coalesce(F.col(label), F.lit("null"))))))
    return examples.select(key, label).join(new.select(key), key, "left_anti").unionByName(checked.select(key, label)).distinct()


def portable(made: FewShot) -> list[dict]:
    """The forest as plain data: per tree, a list of nodes, each {feature, threshold, left, right} or {shares}; <= goes left."""

    def walk(node, nodes: list) -> int:
        at = len(nodes)
        nodes.append({})
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            nodes[at] = {"shares": [x / sum(stats) for x in stats]}
        else:
            split = node.split()
            left, right = walk(node.leftChild(), nodes), walk(node.rightChild(), nodes)
            nodes[at] = {"feature": split.featureIndex(), "threshold": split.threshold(), "left": left, "right": right}
        return at

    out = []
    for tree in made.model.trees:
        nodes: list = []
        walk(tree._call_java("rootNode"), nodes)
        out.append({"nodes": nodes, "trained": made.trained, "classes": made.classes})
    return out


#: What a saved forest says it is; another version is not read.
FORMAT = {"format": "sievework-forest", "version": 1}


def save_portable(trees: list[dict], spark, path: str) -> None:
    """Writes `portable` data as one JSON file, with its format, version and size; a file that is there is not overwritten."""
    import json

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, False)
    try:
        out.write(bytearray(json.dumps(FORMAT | {"n_trees": len(trees), "trees": trees}), "utf-8"))
    finally:
        out.close()


def load_portable(spark, path: str) -> list[dict]:
    """`portable` data from a file of `save_portable`; another format or version, or a damaged file, fails."""
    import json

    held = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if not isinstance(held, dict) or {k: held.get(k) for k in FORMAT} != FORMAT:
        raise ValueError(f"{path} is no forest of version {FORMAT['version']}")
    trees = held["trees"]
    for tree in trees:
        n = len(tree["nodes"])
        if not all("shares" in x or (x["left"] < n and x["right"] < n and "threshold" in x) for x in tree["nodes"]) or not n:
            raise ValueError(f"{path} has a tree with missing nodes")
    if len(trees) != held["n_trees"] or not trees:
        raise ValueError(f"{path} is cut off")
    return trees


def predict_portable(trees: list[dict], vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, probabilities) from `portable` data, without the model: rows of a batch descend all trees together."""
    import numpy as np
    import pandas as pd

    kind = vectors.schema[key].dataType.simpleString()
    classes, trained = trees[0]["classes"], trees[0]["trained"]

    def run(batches):
        for b in batches:
            x = np.array(b["v"].tolist(), np.float64).reshape(len(b), -1)
            total = np.zeros((len(b), len(classes)))
            for tree in trees:
                nodes, at, left = tree["nodes"], np.zeros(len(b), int), np.ones(len(b), bool)
                while left.any():
                    for node in np.unique(at[left]):
                        rows = np.flatnonzero(left & (at == node))
                        n = nodes[node]
                        if "shares" in n:
                            for c, share in zip(trained, n["shares"], strict=False):
                                total[rows, classes.index(c)] += share
                            left[rows] = False
                        else:
                            at[rows] = np.where(x[rows, n["feature"]] <= n["threshold"], n["left"], n["right"])
            yield pd.DataFrame({"k": b["k"], "p": (total / len(trees)).tolist()})

    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"k {kind}, p array<double>").select(F.col("k").alias(key), F.col("p").alias("probabilities"))
