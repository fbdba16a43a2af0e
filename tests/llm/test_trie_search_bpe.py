"""The prefix trie, ranked search and byte-level BPE against brute force, the library, and edge cases."""

import base64
import binascii
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import byte_pairs, prefix_trie, ranked_search
from sievework.llm.registry import vocabulary
from tests.llm.edges import EDGES

TURNS = "conv_id long, turn long, role string, text string, n long, digest string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows):
    sha = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).digest()
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, sha(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h = binascii.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, own_members in members.items():
        below = [x for x in members if x[: len(p)] == p]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own_members) if made[c] == p)
        out.append((min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), children[p], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    return sorted([tuple(r[c] for c in TRIE) for r in prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS)).collect()], key=str)


def test_trie_by_hand(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 8), *range(100, 112), 203, 204, 300, 301, -5, -7]:
        for turn in rng.sample(range(20), rng.randrange(1, 9)):
            rows.append((c, turn if turn else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é🙂", "", None]), 1, "x"))
    rows += [(None, 1, "user", "nobody's", 1, "x"), (104, 3, "user", "a", 1, "x"), (104, 3, "user", "a", 1, "x")]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_long_and_crowded(spark, monkeypatch):
    """Conversations of several blocks of turns, and nodes with more members than a piece holds."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(c, i, "user", f"turn {i}" if i < cut else f"own {c} {i}", 1, "x") for c, n, cut in ((0, 40, 40), (1, 40, 33), (2, 16, 16), (3, 17, 17), (5, 40, 40)) for i in range(n)]
    rows += [(c, 0, "user", "hello", 1, "x") for c in range(400, 440)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_empty(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, None, None, None, None, None)]) == []
    (root,) = [r for r in trie_of(spark, [(7, None, None, None, None, None)]) if r[1] == 0]
    assert root[:4] == (7, 0, None, 1)


def ranks_by_hand(docs, queries, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(key, Counter(words(text))) for key, text in docs]
    bags = [(key, b) for key, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        scored = []
        for key, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(words(text)) if b[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def search_of(spark, docs, queries, k=50, kind="long"):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], f"doc_id {kind}, text string, score long, rank string")
    found = ranked_search.search(docs, spark.createDataFrame(queries, "item_id long, text string"), k)
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()], key=str)


@pytest.mark.parametrize("size", [4, 2048])
def test_search_by_hand(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "RANGE", size)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    rng = random.Random(3)
    vocabulary_ = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary_) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)] + [(5, docs[7][1]), (None, docs[7][1]), (None, None), (400, "É é ÉÉ W1"), (401, " ,.")]
    queries = [(i, docs[i][1].upper()) for i in range(12)] + [(20, None), (21, ""), (22, "no such thing"), (3, "w1 w2"), (23, "w1"), (24, docs[7][1])]
    for k in (5, 50):
        assert search_of(spark, docs, queries, k) == ranks_by_hand(docs, queries, k)


def test_search_edges(spark):
    queries = [(1, "a b"), (2, "word x"), (None, "twice")]
    assert search_of(spark, EDGES, queries) == ranks_by_hand(EDGES, queries, 50)
    assert search_of(spark, [], queries) == [] == search_of(spark, EDGES, [])
    names = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")]
    assert [(r[1], r[2]) for r in search_of(spark, names, [(1, "one")], kind="string")] == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(ValueError):
        search_of(spark, EDGES, queries, 0)


def test_tree_opens_few_nodes_and_whole_ties():
    row = {"docs": list(range(64)), "n": np.full(64, 10), "doc": np.arange(64), "term": np.r_[np.zeros(32, int), np.ones(32, int)], "tf": np.r_[np.ones(60, int), np.full(4, 9)]}
    tree = ranked_search.MaxTree(row, np.array([100, 200]), 64, 640)
    assert [d for d, _ in tree.best(np.array([1]), 4, 1)][:4] == [60, 61, 62, 63]
    assert sorted(d for d, _ in tree.best(np.array([0]), 4, 1)) == list(range(32))  # all tie with the fourth
    assert tree.best(np.array([0]), 4, tree.bound(np.array([0])) + 1) == []


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe[1], mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  ", " \n x", "a  b\n\n c\t d ", "\x1c\x1d a", "x" * 5000, "ab" * 3000 + " " + "é" * 2000, "日本語のテキスト" * 50, "don't I'll we've 's", "🙂🙂　x\xa0z  y", " lead", "trail ", "<|endoftext|> x", "a\u0085 b", None]


def test_bpe_is_the_librarys(spark, bpe, library):
    rng = random.Random(11)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F6FF), 10, 32, 32, 9]))
    texts = [*ODD, *["".join(pick() for _ in range(rng.randrange(1, 400))) for _ in range(200)], " ".join("".join(rng.choice("abcdeſÿ") for _ in range(rng.randrange(1, 30))) for _ in range(3000))]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded array<int>")
    made = byte_pairs.decode(byte_pairs.encode(docs, *bpe), *bpe).collect()
    want = Counter((i if i % 7 else None, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in made) == want


def test_bpe_edges(spark, bpe, library):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    assert Counter((r.doc_id, tuple(r.ids)) for r in byte_pairs.encode(docs, *bpe).collect()) == Counter((k, tuple(library.encode_ordinary(t or ""))) for k, t in EDGES)
    assert byte_pairs.decode(byte_pairs.encode(docs.limit(0), *bpe), *bpe).collect() == []
    bad = spark.createDataFrame([(1, [-1])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="an id that the vocabulary"):
        byte_pairs.decode(bad, *bpe).collect()
    cut = byte_pairs.decode(spark.createDataFrame([([library.encode_ordinary("日")[0]], 5), (None, 6)], "ids array<int>, n int"), *bpe).collect()
    assert bytes(cut[0].decoded) == library.decode_bytes(library.encode_ordinary("日")[:1]) and bytes(cut[1].decoded) == b"" and cut[1].n == 6


def test_matrix_rounds_and_heap_agree(bpe):
    v = byte_pairs.vocabulary(*bpe)
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 16, 17, 200, 1024):
        raw = bytes(rng.choice(b"etaoinshrdlu") for _ in range(size))
        (ids,) = v.merge_rows(v.byte_ids[np.frombuffer(raw, np.uint8)][None, :].copy())
        assert ids == v.merge_long(raw)


def test_pair_table_holds_every_pair():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    table = byte_pairs.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (table(keys >> 32, keys & 0xFFFFFFFF) == np.arange(len(keys))).all()
    assert (table(keys[:9] >> 32, np.full(9, -1)) == byte_pairs.NONE).all() and table(np.array([1]), np.array([(1 << 31) - 2])) == byte_pairs.NONE
