"""Weights, diversity and balance in one choice, against a plain greedy search over all rows."""

import random

import numpy as np
import pytest

from sievework.operators import selection
from sievework.operators.selection import Strategy


def plain(rows, n, how, target, chosen=()):
    classes = sorted({x for r in rows for x in r[3] or ()})
    if target == "uniform":
        target = {c: 1 / len(classes) for c in classes}
    names = list(target) if target else []
    goal = np.array([*target.values(), max(1 - sum(target.values()), 0)]) if target else None
    count = lambda r: np.array([*[(r[3] or []).count(c) for c in names], len(r[3] or []) - sum((r[3] or []).count(c) for c in names)], float)
    taken, left = [r for r in rows if r[0] in chosen], [r for r in rows if r[0] not in chosen]
    top = max(abs(r[1]) for r in left)
    so_far = sum((count(r) for r in taken), np.zeros(len(names) + 1))
    gap = lambda r: np.linalg.norm((so_far + count(r)) / max((so_far + count(r)).sum(), 1e-12) - goal)
    far = lambda r: min(np.linalg.norm(np.subtract(r[2], t[2])) for t in taken)
    out, scale = [], None
    while left and len(out) < n:
        if how.vector and scale is None and taken:
            scale = max(map(far, left)) or 1
        open_ = [r for r in left if not (how.least and taken and far(r) < how.least)]
        if not open_:
            break

        def worth(r):
            value = sum(r[1] / top * w for _, w in how.weights)
            if how.vector:
                value += how.strength * (far(r) / scale if taken else 1)
            return value + (how.balance_strength * (1 - gap(r) / 2**0.5) if target else 0)

        best = max(open_, key=lambda r: (round(worth(r), 10), -r[0]))
        out.append(best[0])
        taken.append(best)
        left.remove(best)
        so_far = so_far + count(best)
    return out


@pytest.mark.parametrize(
    "how",
    [
        Strategy(weights=[("w", 1.0)], balance="uniform"),
        Strategy(weights=[("w", -0.5)], vector="e", strength=0.7, balance={"a": 0.6, "b": 0.1}, balance_strength=2.0),
        Strategy(vector="e", least=0.15, balance="uniform"),
    ],
)
def test_the_greedy_choice(spark, how, monkeypatch):
    monkeypatch.setattr(selection, "BATCH", 12)
    rng = random.Random(12)
    rows = [(i, rng.uniform(-1, 3), [rng.random(), rng.random()], rng.choice([["a"], ["b", "b"], ["a", "c"], [], None, ["c"] * rng.randrange(1, 5)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, w double, e array<double>, labels array<string>")
    got = [r.k for r in selection.select(df, 20, "k", how).orderBy("step").collect()]
    assert got == plain(rows, 20, how, how.balance)
    chosen = [3, 50]
    got = [r.k for r in selection.select(df, 8, "k", how, spark.createDataFrame([(k,) for k in chosen], "k int")).orderBy("step").collect()]
    assert got == plain(rows, 8, how, how.balance, chosen)


def test_balance_over_any_number_of_counts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, 0.0, [0.0], [c for c in "abcd" for _ in range(rng.randrange(4))]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, w double, e array<double>, labels array<string>")
    few = selection.balanced(df, 10, "k", "uniform").orderBy("step").collect()
    monkeypatch.setattr(selection, "MOST_COUNTS", 5)
    many = selection.balanced(df, 10, "k", "uniform").orderBy("step").collect()
    assert [r.k for r in many] == plain(rows, 10, Strategy(balance="uniform"), "uniform") and many[0] == few[0]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0, [0.0], ["a"]), (1, 1.0, None, ["a"]), (2, None, [1.0], None)], "k int, w double, e array<double>, labels array<string>")
    how = Strategy(weights=[("w", 1.0)], vector="e", balance="uniform")
    assert [r.k for r in selection.select(df, 9, "k", how).collect()] == [2]
    assert selection.select(df.limit(0), 9, "k", how).count() == 0
