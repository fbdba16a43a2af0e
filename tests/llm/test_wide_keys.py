"""Near-duplicates among texts that share keys with a crowd of half-similar ones."""

import random

from sievework.llm import simhash


def family(rng, n, pairs):
    """Half-similar texts of one family, and near copies (one word in 120 changed) of some of them."""
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    core = words(70)
    texts = [[*core, *words(50)] for _ in range(n)]
    copies = []
    for i in range(pairs):
        copy = list(texts[i])
        copy[rng.randrange(75, 115)] = "changed"
        copies.append(copy)
    return [" ".join(t) for t in texts], [" ".join(t) for t in copies]


def test_no_link_is_lost_where_keys_are_wide(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    texts, copies = family(random.Random(8), 600, 60)
    docs = spark.createDataFrame([*enumerate(texts), *[(10_000 + i, t) for i, t in enumerate(copies)]], "doc_id long, text string")
    prints = docs.selectExpr("doc_id AS h", "text")

    def signed(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"h": b["h"], "chains": [simhash.chains(simhash.wide_fingerprint(np.array(simhash.shingle_hashes(t, 5), np.uint64))) for t in b["text"]]})

    pairs, crowd = simhash.wide_candidates(prints.mapInPandas(signed, "h long, chains array<long>"), 4)
    assert crowd.count() > 600  # the family does crowd the keys
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(range(600))


def test_crowds_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 2)
    texts, _ = family(random.Random(3), 150, 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 150
