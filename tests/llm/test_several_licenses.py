"""Files with several licences."""

import random

from sievework.llm import licenses


def test_every_licence_of_a_file_is_found(spark, docs_of):
    passages = [(t[0], t[1]) for t in licenses.TEMPLATES]
    texts = [(0, " ".join(p for _, p in passages))]
    texts += [(1 + i * len(passages) + j, f"{a} . and {b}") for i, (_, a) in enumerate(passages) for j, (_, b) in enumerate(passages)]
    # The long passage of the MIT licence is the rarest in the corpus: others fill it with the rest's words.
    texts += [(1_000 + i, " ".join(sorted({w for label, p in passages if label != "mit" for w in p.split()}))) for i in range(200)]
    rows = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs_of(texts)).collect()}
    assert rows[0] == ",".join(sorted({label for label, _ in passages}))
    for i, (a, _) in enumerate(passages):
        for j, (b, _) in enumerate(passages):
            assert rows[1 + i * len(passages) + j] == ",".join(sorted({a, b}))


def test_scan_equals_a_search_of_every_place():
    rnd = random.Random(4)
    index = licenses.Index()
    every = sorted(index.postings)
    idf = {w: rnd.random() for w in every}
    for _ in range(300):
        words: list[bytes] = []
        for _ in range(rnd.randint(1, 6)):
            words += [rnd.choice(every) for _ in range(rnd.randint(0, 60))]
            words += [w if rnd.random() < 0.85 else rnd.choice(every) for w in rnd.choice(index.words)]
        where: dict[bytes, list[int]] = {}
        for at, w in enumerate(words):
            where.setdefault(w, []).append(at)
        want: dict[str, float] = {}
        for t, template in enumerate(index.words):
            for shift in range(-len(template), len(words)):
                share = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(template)) / len(template)
                if share >= licenses.COVERAGE and all(index._stands(words, p, shift + licenses._find(template, p)) for p in index.phrases[t]):
                    want[index.labels[t]] = max(share, want.get(index.labels[t], 0))
        assert index.scan(words, where, idf) == want
