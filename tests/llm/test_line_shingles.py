"""Line dedup's shingles: one from every character on."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import line_dedup


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5A00))), "abcdefghijklmnopqrstuvwxyz0123456789+/", "a😀é漢"])
def test_lines_without_blanks_match_after_a_shift(spark, docs_of, alphabet):
    rnd = random.Random(12)
    texts = []
    for i in range(60):
        line = "".join(rnd.choice(alphabet) for _ in range(300))
        at = 0 if i % 2 else rnd.randrange(300)
        texts += [(2 * i, line), (2 * i + 1, line[:at] + rnd.choice(alphabet) + line[at:])]
    rows = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(texts)).collect()}
    assert [rows[i] for i in range(120)] == [0, 1] * 60


def test_shingles_begin_at_every_character(spark):
    rnd = random.Random(13)
    lines = ["x", "12345678", "123456789", "ab\rc\x85d\u2028 fghijk\r"]
    lines += ["".join(rnd.choice("ab漢😀 ") for _ in range(n)) for n in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    sizes = {r["lh"]: r["n"] for r in df.select("lh", F.size(line_dedup.shingle_set(F.col("line"))).alias("n")).collect()}
    each = F.array(*[f"x{j}" for j in range(line_dedup.STRIDE)])
    hashed = line_dedup.shingle_rows(df).select("lh", F.explode(each).alias("x")).groupBy("lh").agg(F.count_distinct("x").alias("n"))
    hashed = {r["lh"]: r["n"] for r in hashed.collect()}
    for i, line in enumerate(lines):
        n = len({line[a : a + 9] for a in range(max(1, len(line) - 8))})
        assert sizes[i] == hashed[i] == n, line


@pytest.mark.parametrize("low, high, least", [(0.8, 0.85, 0.96), (0.85, 0.95, 0.985), (0.95, 1.0, 0.995)])
def test_recall_of_banding(spark, low, high, least):
    """Of pairs with a similarity from `low` to `high`, nearly all share a band."""
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    grams = lambda t: {t[i : i + 9] for i in range(max(1, len(t) - 8))}
    rows, pairs = [], []
    while len(pairs) < 400:
        a = [rnd.choice(words) for _ in range(rnd.randrange(6, 90))]
        b = list(a)
        for _ in range(rnd.randrange(1, 1 + max(1, len(a) // 6))):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        a, b = " ".join(a), " ".join(b)
        j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if low <= j < high:
            pairs.append(j)
            rows += [(2 * len(pairs), a), (2 * len(pairs) + 1, b)]
    keys = line_dedup.band_keys(spark.createDataFrame(rows, "lh long, line string")).withColumn("pair", F.floor(F.col("lh") / 2))
    met = keys.groupBy("pair").agg(F.collect_list("bands").alias("b")).where(F.arrays_overlap(F.col("b")[0], F.col("b")[1])).count()
    assert met / len(pairs) >= least
