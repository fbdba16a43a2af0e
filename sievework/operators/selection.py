"""Subset selection: weighted, diverse, without near-duplicates, class-balanced, combined, in sequences."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import distance
from sievework.operators.catalog import add_links
from sievework.operators.embeddings import nearest
from sievework.operators.ordering import chunks
from sievework.operators.scratch import cut
from sievework.sources.writers import number_rows

#: Candidates that a round of the greedy search takes to the driver, the same where values may rise, and different class counts it may hold.
BATCH, BALANCED_BATCH, MOST_COUNTS = 64, 1024, 100_000


@dataclass
class Strategy:
    """How to select: any of weights (column, strength), a vector for diversity with its strength and least
    distance, and class balance (target of `balanced`, with the labels' column and a strength)."""

    weights: list = field(default_factory=list)
    vector: str | None = None
    strength: float = 1.0
    least: float | None = None
    balance: object = None
    labels: str = "labels"
    balance_strength: float = 1.0


def weighted(rows: DataFrame, n: int, weights: list[tuple[str, float]], key: str) -> DataFrame:
    """The n rows of largest summed weight, ties by key.

    Each weight column is divided by its largest absolute value and multiplied by its strength; a
    negative strength prefers small values.
    """
    scored = _scored(rows, weights)
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(n).select(*rows.columns, "score")


def _scored(rows: DataFrame, weights: list[tuple[str, float]]) -> DataFrame:
    for c, _ in weights:
        if rows.schema[c].dataType.typeName() in ("string", "boolean", "array", "struct", "map"):
            raise ValueError(f"{c} is no number, so it cannot be a weight")
    if not weights:
        return rows.withColumn("score", F.lit(0.0))
    top = rows.agg(*[F.max(F.abs(c)).alias(f"__m{i}") for i, (c, _) in enumerate(weights)])
    share = lambda i, c: F.when(F.col(f"__m{i}") > 0, F.col(c) / F.col(f"__m{i}")).otherwise(0.0)
    score: Column = sum((share(i, c) * s for i, (c, s) in enumerate(weights)), F.lit(0.0))
    return rows.join(F.broadcast(top)).withColumn("score", score).drop(*[f"__m{i}" for i in range(len(weights))])  # top: one row


def _split(rows: DataFrame, key: str, chosen: DataFrame | None) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows not chosen before, those chosen, number of the first); chosen keys must differ and be among the rows."""
    if chosen is None:
        return rows, None, rows.count()
    counted = chosen.select(key).join(rows.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left")
    bad = counted.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count("__k").alias("k")).first()
    if bad["n"] != bad["d"] or bad["n"] != bad["k"]:
        raise ValueError("rows chosen before must be different rows of the input")
    rest = rows.join(chosen.select(key), key, "left_anti")
    return rest, rows.join(chosen.select(key), key, "left_semi"), rest.count()


def diverse(rows: DataFrame, n: int, key: str, vector: str, least: float | None = None, chosen: DataFrame | None = None, weights: list[tuple[str, float]] | None = None, strength: float = 1.0) -> DataFrame:
    """(key, step): greedy farthest-first choice; with nothing chosen before, the least key is first; ties by key.

    With `least`, it stops when no row is that far from all chosen ones, so near-duplicates stay out.
    `chosen` (keys) count as chosen before and are not returned; n is cut to what is there. Rows with a null
    key or vector cannot be chosen and are left out, also of what was chosen before. With `weights`, a row's value is its summed weight plus `strength` times its distance, divided by the
    largest distance from the first choice.

    The search is exact but takes many steps per pass: a pass brings the BATCH best rows to the driver,
    and as values only fall, the best of these is the best of all while it is above the first one left
    behind. Each pass then updates every row's distance once for all new choices.
    """
    if chosen is not None:
        chosen = chosen.join(rows.where(F.col(vector).isNull()).select(key), key, "left_anti")
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rest, before, available = _split(rows, key, chosen)
    n = min(n, available)
    scored = _scored(rest, weights or [])
    state = scored.select(key, F.col(vector).cast("array<double>").alias("__v"), F.col("score").alias("__s"), F.lit(None).cast("double").alias("__d"))
    if before is not None:
        near = nearest(rest, before, key, vector).select(F.col("k").alias(key), F.col("d").alias("__n"))
        state = cut(state.join(near, key, "left").withColumn("__d", F.least("__d", "__n")).drop("__n"))
    out: list = []
    scale: float | None = None
    while len(out) < n:
        if scale is None:
            top = state.agg(F.max("__d")).first()[0]
            scale = (top or 1.0) if top is not None else None
        value = F.col("__s") + F.lit(strength) * F.coalesce(F.col("__d"), F.lit(1.0)) / F.lit(scale or 1.0)
        best = _first(state.withColumn("__x", value), key, 1 if scale is None else BATCH + 1)
        if not best:
            break
        bound = best[-1]["__x"] if len(best) > BATCH else -np.inf
        vectors, static = np.array([r["__v"] for r in best]), np.array([r["__s"] for r in best])
        far = np.array([np.inf if r["__d"] is None else r["__d"] for r in best])
        worth, open_ = np.array([r["__x"] for r in best]), np.ones(len(best), bool)
        picks: list[int] = []
        while open_.any() and len(out) + len(picks) < n:
            i = int(np.where(open_, worth, -np.inf).argmax())  # the first of equals has the least key
            if picks and worth[i] <= bound:
                break
            if least is not None and np.isfinite(far[i]) and far[i] < least:
                open_[i] = False
                if not weights:
                    break
                continue
            picks.append(i)
            open_[i] = False
            far = np.minimum(far, np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1)))
            worth = static + strength * far / (scale or 1.0)
            if scale is None:
                break
        if not picks:
            break
        out += [(best[i][key], len(out) + k) for k, i in enumerate(picks)]
        gone = [best[i][key] for i in picks]
        state = cut(_nearer(state.where(~F.col(key).isin(gone)), [vectors[i].tolist() for i in picks]))
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"{key} {kind}, step int")


def _first(valued: DataFrame, key: str, n: int) -> list:
    """The n rows of largest __x, ties by key.

    A task merges what each partition has of them and writes it: collected directly, every partition
    would send its own n rows to the driver.
    """
    return cut(valued.orderBy(F.desc("__x"), key).limit(n)).collect()


def _nearer(state: DataFrame, vectors: list) -> DataFrame:
    """`state` with each row's distance lowered to the nearest of a few vectors."""
    near = F.array_min(F.transform(F.lit(vectors) if vectors else F.array(), lambda p: distance(F.col("__v"), p)))
    return state.withColumn("__d", F.least("__d", near))


def class_targets(rows: DataFrame, labels: str, target) -> dict:
    """Target share per class: a dict as it is, "uniform" over all classes, or "input" as the rows have them.

    A dict may name only known classes; the classes themselves are a small dimension.
    """
    counts = {r["c"]: r["n"] for r in rows.select(F.explode(labels).alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()}
    if target == "uniform":
        return {c: 1.0 / len(counts) for c in counts}
    if target == "input":
        return {c: n / sum(counts.values()) for c, n in counts.items()}
    if not isinstance(target, dict):
        raise ValueError("a target is uniform, input or a share per class")
    for c in target:
        if c not in counts:
            raise ValueError(f"no such class: {c}")
    return dict(target)


def _class_counts(rows: DataFrame, labels: str, target) -> tuple[np.ndarray, Column]:
    """(target shares, array of a row's counts): the classes of the target, then all others together."""
    shares = class_targets(rows, labels, target)
    held_of = lambda c: F.size(F.filter(labels, lambda x: x == F.lit(c)))
    counts = [held_of(c) for c in shares]
    vector = F.array(*counts, F.size(labels) - sum(counts, F.lit(0))).cast("array<double>")
    goal = np.array([*shares.values(), max(1.0 - sum(shares.values()), 0.0)])
    return goal, F.when(F.col(labels).isNull(), F.array_repeat(F.lit(0.0), len(goal))).otherwise(vector)


def _summed(before: DataFrame | None, vector: Column, size: int) -> np.ndarray:
    """The class counts of rows chosen before."""
    out = np.zeros(size)
    if before is not None:
        for r in before.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
    return out


def _gaps(counts: np.ndarray, so_far: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """How far the class shares are from the target once each of some rows is taken."""
    sums = counts + so_far
    return np.sqrt(((sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12) - goal) ** 2).sum(axis=1)).round(12)


def combined(rows: DataFrame, n: int, key: str, how: Strategy, chosen: DataFrame | None = None) -> DataFrame:
    """(key, step): each step takes the row of largest value, ties by key.

    A value is the row's summed weight (see `weighted`), plus the strength of diversity times the distance to the
    nearest chosen row as a share of the largest distance from the first choice (before it: one), plus
    the strength of balance times 1 - gap / sqrt(2), the gap being how far the class shares are from the
    target once the row is taken (see `balanced`). `how.least` keeps out rows nearer than that to a
    chosen one. What `how` lacks does not count. Rows with a null key, or a null vector where one counts, are left out;
    null labels are none. n is cut to what is there.

    The search is exact but takes many steps per pass. A pass brings the BATCH (with balance BALANCED_BATCH) best
    rows to the driver. Of the others no value rises but for balance, and that by at most sqrt(2) * m / t once m of t class counts are new;
    while the best of the batch is above the first row left behind and that rise, it is the best of all.
    """
    rows = rows.where(F.col(key).isNotNull())
    if how.vector is not None:
        if chosen is not None:
            chosen = chosen.join(rows.where(F.col(how.vector).isNull()).select(key), key, "left_anti")
        rows = rows.where(F.col(how.vector).isNotNull())
    goal, counts = _class_counts(rows, how.labels, how.balance) if how.balance is not None else (np.zeros(1), F.array(F.lit(0.0)))
    force = how.balance_strength if how.balance is not None else 0.0
    spread = how.strength if how.vector else 0.0
    rest, before, available = _split(rows, key, chosen)
    n, so_far = min(n, available), _summed(before, counts, len(goal))
    place = F.col(how.vector).cast("array<double>") if how.vector else F.array(F.lit(0.0))
    state = _scored(rest, how.weights).select(key, place.alias("__v"), F.coalesce("score", F.lit(0.0)).alias("__s"), F.lit(None).cast("double").alias("__d"), counts.alias("__c"))
    if before is not None and how.vector:
        near = nearest(rest, before, key, how.vector).select(F.col("k").alias(key), F.col("d").alias("__d"))
        state = state.drop("__d").join(near, key, "left")
    state = cut(state)
    out: list = []
    batch = BALANCED_BATCH if force else BATCH
    scale: float | None = None if how.vector else 1.0
    while len(out) < n:
        if scale is None and (top := state.agg(F.max("__d")).first()[0]) is not None:
            scale = top or 1.0
        sums = F.zip_with("__c", F.lit(so_far.tolist()), lambda a, b: a + b)
        total = F.greatest(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x), F.lit(1e-12))
        gap = F.round(F.sqrt(F.aggregate(F.zip_with(F.transform(sums, lambda x: x / total), F.lit(goal.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)), 12)
        far_share = F.coalesce(F.col("__d"), F.lit(scale or 1.0)) / F.lit(scale or 1.0)
        value = F.col("__s") + F.lit(spread) * far_share + F.lit(force) * (1 - gap / 2**0.5)
        open_rows = state if how.least is None or not how.vector else state.where(F.col("__d").isNull() | (F.col("__d") >= how.least))
        best = _first(open_rows.withColumn("__x", value), key, batch + 1)
        if not best:
            break
        bound = best[-1]["__x"] if len(best) > batch else -np.inf
        vectors, static, held = (np.array([r[c] for r in best]) for c in ("__v", "__s", "__c"))
        far = np.array([np.inf if r["__d"] is None else r["__d"] for r in best])
        open_, picks, new = np.ones(len(best), bool), [], 0.0
        while open_.any() and len(out) + len(picks) < n:
            shares = np.where(np.isfinite(far), far, scale or 1.0) / (scale or 1.0)
            worth = np.where(open_, static + spread * shares + force * (1 - _gaps(held, so_far, goal) / 2**0.5), -np.inf)
            i = int(worth.argmax())  # the first of equals has the least key
            rise = force * 2**0.5 * new / max(so_far.sum(), 1e-12) if new else 0.0
            if picks and worth[i] <= bound + abs(rise) + 1e-9 * bool(force):
                break
            picks.append(i)
            open_[i] = False
            so_far, new = so_far + held[i], new + held[i].sum()
            if how.vector:
                far = np.minimum(far, np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1)))
                open_ &= how.least is None or far >= how.least
            if scale is None:
                break
        out += [(best[i][key], len(out) + k) for k, i in enumerate(picks)]
        state = state.where(~F.col(key).isin([best[i][key] for i in picks]))
        state = cut(_nearer(state, [vectors[i].tolist() for i in picks]) if how.vector else state)
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"{key} {kind}, step int")


def balanced(rows: DataFrame, n: int, key: str, target, labels: str = "labels", chosen: DataFrame | None = None) -> DataFrame:
    """(key, step): each step takes a row that brings the summed class counts nearest to the target shares.

    `labels`: array of a row's class names, repeated as often as it has them (null: none). target: see
    `class_targets`; shares may sum to less than one, the rest goes to all other classes. Nearness is the
    Euclidean distance of the shares. Rows with the same class counts are alike, so the search runs
    over the different counts and one join takes the rows, least keys first; of equally near counts the
    one with the least key of all its rows comes first. Beyond MOST_COUNTS different counts the rows
    themselves are searched, see `combined`. n is cut to what is there; `chosen` (keys) count as chosen before.
    """
    goal, vector = _class_counts(rows, labels, target)
    rest, before, available = _split(rows, key, chosen)
    held = rest.select(key, vector.alias("c"))
    kinds = held.groupBy("c").agg(F.count("*").alias("n"), F.min(key).alias("least")).orderBy("least").limit(MOST_COUNTS + 1).collect()
    if len(kinds) > MOST_COUNTS:
        return combined(rows, n, key, Strategy(balance=target, labels=labels), chosen)
    so_far = _summed(before, vector, len(goal))
    matrix, left = np.array([r["c"] for r in kinds]).reshape(len(kinds), len(goal)), np.array([r["n"] for r in kinds])
    taken, order = np.zeros(len(kinds), int), []
    for step in range(min(n, available)):
        i = int(np.where(taken < left, _gaps(matrix, so_far, goal), np.inf).argmin())
        order.append((kinds[i]["c"], int(taken[i]), step))
        taken[i] += 1
        so_far = so_far + matrix[i]
    from pyspark.sql import Window

    places = rows.sparkSession.createDataFrame(order, "c array<double>, r int, step int")
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(key)) - 1)
    return ranked.join(places, ["c", "r"]).select(key, "step")


def select(rows: DataFrame, n: int, key: str, how: Strategy, chosen: DataFrame | None = None) -> DataFrame:
    """(key, step) of the n rows to take by a strategy; rows chosen before are not returned but count."""
    if how.balance is not None:
        if how.weights or how.vector:
            return combined(rows, n, key, how, chosen)
        return balanced(rows, n, key, how.balance, how.labels, chosen)
    if how.vector:
        return diverse(rows, n, key, how.vector, how.least, chosen, how.weights, how.strength)
    if not how.weights:
        raise ValueError("a strategy has weights, a vector or a balance")
    rest, _, available = _split(rows, key, chosen)
    best = weighted(rest, min(n, available), how.weights, key)
    placed = number_rows(best.select(key, (-F.coalesce("score", F.lit(float("-inf")))).alias("__s")), ["__s", key], "step")
    return placed.select(key, F.col("step").cast("int").alias("step"))


def tag_result(links: DataFrame, picked: DataFrame, key: str, tag: str) -> DataFrame:
    """`links` (key, tag) with the picked rows under a new tag; a tag that is there already is an error."""
    if not links.where(F.col("tag") == tag).limit(1).isEmpty():
        raise ValueError(f"the tag {tag} exists already")
    return add_links(links.select(key, "tag"), picked.select(key, F.lit(tag).alias("tag")))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, vector) of each group's mean: what stands for a sequence when sequences are chosen.

    Elements are averaged by place, with partial sums before the shuffle.
    """
    places = rows.select(*keys, F.posexplode(vector).alias("__at", "__x")).groupBy(*keys, "__at").agg(F.avg("__x").alias("__m"))
    listed = places.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", "__m"))).alias("__ms"))
    return listed.select(*keys, F.transform("__ms", lambda p: p["__m"]).alias(vector))


def sequences(frames: DataFrame, n: int, length: int, key: str, video: str, order: str, vector: str, chosen: DataFrame | None = None) -> DataFrame:
    """(key, step) of n frames in diverse sequences of `length` consecutive frames; n must be its multiple.

    Frames chosen before and the others are cut into sequences separately; unfilled ends are left out.
    Sequences are compared by their mean vectors, and every frame of a chosen sequence is returned.
    """
    if length < 2 or n % length:
        raise ValueError("sequences have at least two frames, and n is a multiple of their length")
    cut_up = lambda part: chunks(part, video, order, length)
    parts = [(cut_up(frames), 0)] if chosen is None else [(cut_up(frames.join(chosen.select(key), key, "left_anti")), 0), (cut_up(frames.join(chosen.select(key), key, "left_semi")), 1)]
    held = None
    for part, before in parts:
        named = part.withColumn("__b", F.lit(before))
        held = named if held is None else held.unionByName(named)
    # In the order of videos and their frames; what follows the video has a fixed width, so no two sequences share a name.
    name = F.col(video).cast("string")
    if frames.schema[video].dataType.typeName() in ("byte", "short", "integer", "long"):
        name = F.concat(F.when(F.col(video) < 0, "-").otherwise("0"), F.lpad(F.regexp_replace(name, "-", ""), 20, "0"))
    held = held.withColumn("__id", F.concat(name, F.lit("\u0001"), F.lpad(F.col("chunk").cast("string"), 12, "0"), F.col("__b").cast("string")))
    proxies = mean_vectors(held, ["__id", "__b"], vector)
    old = proxies.where("__b = 1").select("__id") if chosen is not None else None
    picked = diverse(proxies, n // length, "__id", vector, chosen=old)
    return held.join(picked, "__id").select(key, "step")
