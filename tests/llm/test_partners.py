"""Near-duplicates: every link of like texts is found, and texts that cannot have one are not compared."""

import random

import numpy as np

from sievework.llm import simhash


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


#: Seeds of pairs that shared none of the fingerprints' keys, of 198,347 pairs with a similarity from 0.8 to 0.83.
LOST = [16036, 57781, 61475, 310095, 356518, 363979, 367157, 378790, 383521, 395369, 396156]


def pair(seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 80))]
    copy = list(words)
    copy[rng.randrange(5, len(copy) - 5)] = "changed"
    return " ".join(words), " ".join(copy)


def test_no_link_at_the_threshold_is_lost(spark):
    docs = [text for seed in [*LOST, *range(300)] for text in pair(seed)]
    alike = {i for i in range(0, len(docs), 2) if likeness(docs[i], docs[i + 1]) >= 0.8}
    assert len(alike) > 200 and set(range(0, 2 * len(LOST), 2)) <= alike
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert kept == set(range(len(docs))) - {i + 1 for i in alike}


def test_a_common_passage_makes_no_candidates(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(25)
    docs = [(i, " ".join([*words(50), *passage, *words(50)])) for i in range(400)]
    rows, real = {}, simhash.table

    def counted(df, name):
        made = real(df, name)
        rows[name] = made.count()
        return made

    monkeypatch.setattr(simhash, "table", counted)
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).count() == 400
    assert rows["simhash-sets"] == rows["simhash-wide-keys"] == rows["simhash-wide-pairs"] == 0  # hundreds when each text had keys


def test_first_hashes_of_partners_meet():
    rng, drawn, tested = random.Random(2), np.random.default_rng(2), 0
    while tested < 400:
        n = rng.randrange(1, 200)
        both = drawn.integers(0, 1 << 63, 2 * n + 2, np.uint64)
        a, b = np.unique(both[:n]), np.unique(both[rng.randrange(n // 6 + 1) : n + rng.randrange(n // 6 + 1)])
        common = np.intersect1d(a, b)
        if len(common) / len(np.union1d(a, b)) >= 0.8:
            tested += 1
            for spare in (0, simhash.SPARE):
                (x, x_need), (y, y_need) = simhash.firsts(a, 0.8, spare), simhash.firsts(b, 0.8, spare)
                assert len(np.intersect1d(x, y)) >= max(x_need, y_need)


def test_quick_shingles_are_the_same_shingles():
    texts = ["", " \t\n", "a", "A b", "a b c d e", "É é A a\x0b b\x85c", " x  y ", "z" * 63 + " " + "z" * 64 + " " + "z" * 64 + "a", "ab ba ab ba ab ba ab ba"]
    texts += [" ".join(random.Random(i).choices(["the", "of", "été", "a", "b", "ab", "ba"], k=80)) for i in range(50)]
    old, new = {}, {}
    for t in texts:
        for x, y in zip(simhash.shingle_hashes(t, 5), simhash.quick_shingles(t, 5).tolist(), strict=True):
            assert old.setdefault(x, y) == y and new.setdefault(y, x) == x
