"""Operators that SQL cannot express, against plain Python over small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from edges import EDGES
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import imatch, language_id, licenses, registry, simhash, surrogates

CLASHES = ("score", "lang_pred", "__text", "n_lines", "n_dropped", "__gone", "h", "k", "g", "row", "c0", "chains", "lh")


def soup(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]


def test_imatch_signatures_and_likeness():
    """A signature stands for the set of terms that a subset holds; likeness is the share of equal sets."""
    rnd = random.Random(1)
    words = vocabulary(rnd, 500)
    texts = [soup(rnd, rnd.randrange(0, 200), words) for _ in range(12)]
    texts += [texts[0] + " " + words[0], texts[1]]
    terms = [imatch.term_hashes(t) for t in texts]
    signed = imatch.signatures(terms)

    def held(hashes, level, k):
        return frozenset(int(h) for h in hashes if float(imatch._mix(np.array([h]), 2 * k + 1)[0]) < imatch.SHARES[level] * 2.0**64)

    sets = [[[held(t, level, k) for k in range(imatch.SUBSETS)] for level in range(len(imatch.SHARES))] for t in terms]
    for a in range(len(texts)):
        for b in range(a):
            touched = [sum(bool(x or y) for x, y in zip(sets[a][v], sets[b][v], strict=True)) for v in range(len(imatch.SHARES))]
            full = [v for v, n in enumerate(touched) if 2 * n >= imatch.SUBSETS]
            level = full[-1] if full else int(np.argmax(touched))
            equal = sum(bool(x) and x == y for x, y in zip(sets[a][level], sets[b][level], strict=True))
            want = 1.0 if set(map(int, terms[a])) == set(map(int, terms[b])) else equal / max(touched[level], 1)
            assert abs(imatch.likeness(signed[a], signed[b]) - want) < 1e-9


def test_imatch_next_rows_with_ties_nulls_and_many_ranges(spark, docs_of):
    rnd = random.Random(2)
    words = vocabulary(rnd, 300)
    pairs = [(rnd.randrange(60), soup(rnd, 30, words)) for _ in range(90)] + [(None, soup(rnd, 30, words)) for _ in range(9)]
    docs = docs_of(pairs)
    made = imatch.compare_with_edits(docs, rows_per_range=3).select("doc_id", "n_chars", "edited_sha256").collect()
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), hashed[p[1]]))
    import hashlib

    want = []
    for i, (key, own) in enumerate(order):
        following, cut = order[(i + 1) % len(order)][1], len(own) // 3
        want.append((key, len(own), hashlib.sha256((own[: len(own) - cut] + following[:cut]).encode()).hexdigest()))
    assert sorted(((r[0], r[1], r[2]) for r in made), key=str) == sorted(want, key=str)


def test_imatch_family_of_a_third(spark, docs_of):
    """Near copies are alike whether they are few or a third of all rows."""
    rnd = random.Random(3)
    words = vocabulary(rnd, 4_000)
    base = [rnd.choice(words) for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(base) if i % 3 == 0 else [rnd.choice(words) for _ in range(200)]
        if i % 3 == 0:
            own[rnd.randrange(200)] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    family = docs_of([r for r in rows if r[0] % 3 == 0] + [(1_000 + i, t) for i, t in rows if i % 3])
    made = imatch.compare_with_edits(family).where("doc_id < 297").toPandas()
    assert made.near_next.mean() > 0.9 and made.near_edited.mean() > 0.4


def test_language_scores(spark, docs_of):
    """Scores by hand: each trigram's vector bound letter by letter, bundled, compared by cosine."""
    symbol = language_id._symbol_of()
    two, one, none = language_id._letters(64, 7)

    def vector(text):
        s = [0]
        for c in [*(int(symbol[ord(c)]) for c in (text or "").lower()), 0]:
            if c or s[-1]:
                s.append(c)
        total = np.zeros(64)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            total += two[a].astype(float) * one[b] * none[c]
        return total

    rnd = random.Random(4)
    texts = [(i, soup(rnd, rnd.randrange(1, 40), ["der", "und", "Haus", "the", "and", "élan", "漢字", "12", "!"])) for i in range(40)] + EDGES[:5] + [(77, "?? 12"), (78, "word " * 9_000)]
    known = [(i, t, ["de", "en"][i % 2]) for i, t in texts if t and i < 40]
    labels, prototypes = language_id.learn(spark.createDataFrame(known, "doc_id long, text string, lang string"), dimensions=64)
    sums = {k: sum(vector(t) for _, t, lang in known if lang == k) for k in labels}
    rows = language_id.predict(docs_of(texts), labels, prototypes, dimensions=64).collect()
    want = []
    for i, t in texts:
        v = vector(t)
        near = [float(v @ sums[k] / max(np.linalg.norm(v) * np.linalg.norm(sums[k]), 1e-12)) for k in labels]
        letters = any(c.isalpha() for c in t or "")
        want.append((i, labels[int(np.argmax(near))] if letters else "und", max(0.0, *near) if letters else 0.0))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == sorted((a, b) for a, b, _ in want)
    assert np.allclose(sorted(r["score"] for r in rows), sorted(w[2] for w in want), atol=1e-5)


def test_languages_keep_rows_where_nothing_was_learned(spark, docs_of):
    docs = docs_of([*EDGES, (9, "12 34")]).withColumns({c: F.lit(1) for c in CLASHES})
    none = language_id.keep_told(docs, *language_id.learn(docs.limit(0)))
    some = language_id.keep_told(docs.withColumn("lang", F.lit(None).cast("string")), *language_id.learn(docs))
    for made in (none, some):
        assert sorted((r["doc_id"] for r in made.collect()), key=str) == [3, 4, 7, 7, None] and made.columns == docs.columns
    assert {r["lang"] for r in some.collect()} == {"en"}


def test_licenses_by_trying_every_place(spark, docs_of):
    rnd = random.Random(5)
    index = licenses.Index()
    words = sorted({w.decode() for ws in index.words for w in ws})
    texts = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randrange(0, 4)):
            t = list(rnd.choice(licenses.TEMPLATES)[1].split())
            for _ in range(rnd.randrange(0, len(t) // 2)):
                t[rnd.randrange(len(t))] = rnd.choice([*words, "zzz"])
            parts += t + [rnd.choice([*words, "zzz"]) for _ in range(rnd.randrange(0, 12))]
        texts.append((i, " ".join(parts)))

    def brute(text):
        w, labels = text.split(), set()
        for label, template, phrases in licenses.TEMPLATES:
            t = template.split()
            for shift in range(-len(t) + 1, len(w)):
                hits = sum(0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(t))
                stand = all(any(t[i : i + len(p)] == p and 0 <= shift + i and w[shift + i : shift + i + len(p)] == p for i in range(len(t))) for p in (x.split() for x in phrases))
                if hits >= licenses.COVERAGE * len(t) - 1e-9 and stand:
                    labels.add(label)
        for phrase, label in licenses.BASE.items():
            if f" {phrase} " in f" {text} ":
                labels.add(label)
        return ",".join(sorted(labels))

    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs_of(texts)).collect()}
    assert got == {i: brute(t) for i, t in texts} and len(set(got.values())) > 10


@pytest.mark.parametrize("mapped", [50_000, 0])
def test_surrogates_of_one_person(spark, docs_of, monkeypatch, mapped):
    monkeypatch.setattr(surrogates, "MAPPED", mapped)
    texts = [(1, "Dr Anna Schmidt met Frau Anna Schmidt."), (2, "Frau Karin Schmidt, and Karin again"), (3, "Herr Andrea Rossi"), (4, "Prof Karin Weber"), (5, "+1 22 33 44 and +49 170 1234567"), (6, None), (None, "")]
    docs = docs_of(texts).withColumns({c: F.lit(1) for c in CLASHES})
    rows = {r["doc_id"]: r for r in surrogates.pseudonymise(docs, "k", keep=("score", "h", "n_dropped")).collect()}
    one = rows[1]["text"].rstrip(".").split()
    assert one[1:3] == one[5:7] and "Anna" not in rows[1]["text"]
    assert rows[2]["text"].split()[1] == rows[4]["text"].split()[1] == rows[2]["text"].split()[4]
    assert rows[2]["text"].split()[1].endswith("la") and rows[3]["text"].split()[1].endswith("s")  # as the titles say
    assert rows[2]["text"].split()[2].rstrip(",") == one[2]
    assert rows[5]["text"].startswith("+1 ") and " and +49 " in rows[5]["text"] and rows[6]["text"] is None and rows[None]["text"] == ""


def test_overlaps_of_very_many_entities():
    text = " ".join(f"user{i}@corp{i}.example.org" for i in range(30_000))
    found = surrogates.entities(text)
    assert len(found) == 30_000 and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_simhash_query_against_brute_force(spark, docs_of):
    import xxhash

    rnd = random.Random(6)
    words = vocabulary(rnd, 400)
    texts = [*EDGES[:5]]
    for i in range(40):
        own = [rnd.choice(words) for _ in range(rnd.randrange(1, 300))]
        texts.append((100 + 2 * i, " ".join(own)))
        own[rnd.randrange(len(own))] = rnd.choice(words)
        texts.append((101 + 2 * i, "\t".join(own).upper()))
    prints = {}
    for i, t in texts:
        w = (t or "").lower().split()
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    rows = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs_of(texts)).collect()}
    assert rows == {i: (prints[i], label[i]) for i in prints} and Counter(label.values()).most_common(1)[0][1] > 1


def test_near_duplicates_of_the_pipeline(spark, docs_of):
    """Of pairs of a similarity of 0.8 or more nearly all are found, and no other document goes."""
    rnd = random.Random(7)
    words = vocabulary(rnd, 3_000)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    rows, near, far = [], [], []
    for i in range(400):
        a = [rnd.choice(words) for _ in range(rnd.randrange(60, 300))]
        b = list(a)
        for _ in range(max(1, int(len(a) * rnd.uniform(0.002, 0.06)))):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        (near if j >= 0.8 else far).append(i)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(rows)).collect()}
    assert all(2 * i in kept for i in range(400)) and all(2 * i + 1 in kept for i in far)
    assert sum(2 * i + 1 not in kept for i in near) >= 0.95 * len(near) > 50


def test_stages_on_edges_and_clashing_names(spark, docs_of):
    docs = docs_of([*EDGES, (8, "plain words of a clean text"), (8, "plain words of a clean text")]).withColumns({c: F.lit("x") for c in CLASHES})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == docs.columns and made.where("doc_id = 8").count() >= 1, name
        assert made.where("doc_id IS NULL").count() == 1 and {r["score"] for r in made.collect()} == {"x"}, name
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == 8 and registry.queries()["pipeline"] is corpus_pipeline.run
