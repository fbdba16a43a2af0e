"""Prototypes of many labels, each against its own plain sum."""

import random

import numpy as np

from sievework.llm import language_id


def test_a_prototype_for_each_of_many_labels(spark, docs_of, monkeypatch):
    monkeypatch.setattr(language_id, "COUNTED", 500)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 60))), f"l{i % 700}") for i in range(1500)] + [(-1, None, "l1"), (-2, "abc", None), (-3, "...", "silent")]
    labels, made = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert labels == sorted({lang for _, text, lang in rows if lang and len(language_id.grams(text))}) and "silent" not in labels
    for at in rng.sample(range(len(labels)), 40):
        want = sum(language_id.gram_vectors(language_id.grams(t)).sum(axis=0, dtype=np.float64) for _, t, lang in rows if lang == labels[at])
        assert np.allclose(made[at], want / max(np.linalg.norm(want), 1e-12), atol=1e-9)
    assert language_id.learn(spark.createDataFrame([], "text string, lang string"))[1].shape == (0, language_id.DIMENSIONS)
