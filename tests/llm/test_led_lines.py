"""Copies in a narrow band meet its leader, not each other."""

import random

from pyspark.sql import functions as F

from sievework.llm import line_dedup


def test_copies_in_narrow_bands_are_not_paired(spark, monkeypatch):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(60)]
    lines = [" ".join([*base[:59], f"{word()}{i}"]) for i in range(20)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("lh"), "line").cache()
    counts, real = {}, line_dedup.table

    def counted(df, name):
        made = real(df, name)
        counts[name] = made.count()
        return made

    monkeypatch.setattr(line_dedup, "table", counted)
    found = line_dedup.line_components(rows).collect()
    assert len(found) == 20 and len({r["component"] for r in found}) == 1
    assert counts["line-pairs"] == 0  # 190 when every pair of a band was compared
