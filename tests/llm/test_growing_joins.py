"""Keys of near-duplicates: like texts share one, unlike ones do not."""

import random

import numpy as np
import pytest

from sievework.llm import simhash


def prints_of(texts):
    return [simhash.chains(simhash.wide_fingerprint(np.array(simhash.shingle_hashes(t, 5), np.uint64))) for t in texts]


def test_unlike_texts_share_no_key(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3000)]
    rows, real = {}, simhash.table

    def counted(df, name):
        made = real(df, name)
        rows[name] = made.count()
        return made

    monkeypatch.setattr(simhash, "table", counted)
    prints = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(prints_of(texts))], "h long, chains array<long>")
    pairs, _ = simhash.wide_candidates(prints)
    assert pairs.count() == 0 and rows["simhash-wide-keys"] == 0  # hundreds when 21 bits alone were the key


@pytest.mark.parametrize("low, high, least", [(0.8, 0.85, 0.98), (0.85, 0.9, 0.995), (0.9, 1.0, 0.998)])
def test_recall_of_keys(low, high, least):
    """Of pairs with a similarity from `low` to `high`, nearly all share a key."""
    rng, pairs, met = random.Random(6), 0, 0
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    while pairs < 500:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 300))]
        b = list(a)
        for _ in range(rng.randrange(1, 2 + len(a) // 40)):
            b[rng.randrange(len(b))] = "changed"
        b = b[: len(b) - rng.randrange(3)]
        if low <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < high:
            pairs += 1
            x, y = prints_of([" ".join(a), " ".join(b)])
            met += bool((x == y).any())
    assert met / pairs >= least
