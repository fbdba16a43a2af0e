"""Lines of a family that are half alike: few of them are compared, and no match is lost."""

import random

from pyspark.sql import functions as F

from sievework.llm import components, line_dedup


def test_half_similar_lines_are_not_paired(spark, monkeypatch):
    """Copies whose edits are their own and match nobody, beside drifting ones that do match."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(60)]
    lines = {" ".join(base)}
    for _ in range(200):
        own = list(base)
        for i in rng.sample(range(60), 4):
            own[i] = word()
        lines.add(" ".join(own))
    for _ in range(3):
        own = list(base)
        for _ in range(12):
            own[rng.randrange(60)] = word()
            lines.add(" ".join(own))
    rows = spark.createDataFrame([(x,) for x in sorted(lines)], "line string").select(F.xxhash64("line").alias("lh"), "line").cache()
    asked, real = [], line_dedup.matches

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(line_dedup, "matches", counted)
    found = dict(map(tuple, line_dedup.line_components(rows).collect()))
    pairs = rows.select(F.col("lh").alias("u"), F.col("lh").alias("v"))
    texts = {r["lh"]: set(r["s"]) for r in line_dedup.shingle_sets(pairs, rows).collect()}
    true = [(a, b) for a in texts for b in texts if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    brute = dict(map(tuple, components.connected_components(spark.createDataFrame(true, "u long, v long")).collect()))
    assert found == brute
    assert asked[1] <= len(rows.collect())
