"""Ranked lexical search: best-first branch and bound over trees of maxima, a tree for each range of documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

#: A range has at most this many documents, and fewer where a block of queries has many terms.
RANGE = 2048
#: Cells (documents x terms, eight bytes each) of a range's leaves.
CELLS = 1 << 23
#: Children of a node.
FAN_OUT = 16
#: A block of queries ends at so many queries or, from its second query on, at so many different terms; blocks are searched one after another.
BLOCK_QUERIES, BLOCK_TERMS = 1024, 4096
#: Ranges that each query opens to find a bound for all others.
FIRST = 4

#: Bytes to the bytes of words: A-Z lowered, all that separates words a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Types of keys that Python orders as Spark does.
ORDERED = ("tinyint", "smallint", "int", "bigint", "string", "date")


def words(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters (lowered), ASCII digits and bytes beyond ASCII."""
    return raw.translate(WORD_BYTES).split()


def ranges_of(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Documents with a word, in ranges: their ids and lengths, and each asked term's count in each document.

    A range is a run of rows of the scan, so no text is shuffled; its documents are ordered by the number of asked
    terms that they hold, so that subtrees are alike.
    """
    kind = docs.schema[key].dataType.simpleString()
    size = max(FAN_OUT, min(RANGE, CELLS // max(1, len(terms))))

    def row(at: int, ids: list, lengths: list[int], held: list[np.ndarray]) -> dict:
        order = np.argsort([len(x) for x in held], kind="stable").tolist()
        pairs = [np.unique(held[i], return_counts=True) for i in order]
        return {"range": at, "docs": [ids[i] for i in order], "n": [lengths[i] for i in order], "doc": np.repeat(np.arange(len(ids)), [len(t) for t, _ in pairs]), "term": np.concatenate([t for t, _ in pairs]), "tf": np.concatenate([c for _, c in pairs])}

    def run(batches):
        at, ids, lengths, held = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            schema = pa.schema([("range", pa.int64()), ("docs", pa.list_(batch.schema.field("key").type)), ("n", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("doc", "term", "tf"))])
            for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
                if found := words(raw.as_py()) if raw.is_valid else None:
                    ids.append(doc.as_py())
                    lengths.append(len(found))
                    held.append(np.array([t for t in map(terms.get, found) if t is not None], np.int32))
                if len(ids) == size:
                    yield pa.RecordBatch.from_pylist([row(at, ids, lengths, held)], schema)
                    at, ids, lengths, held = at + 1, [], [], []
        if ids:
            yield pa.RecordBatch.from_pylist([row(at, ids, lengths, held)], schema)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"range long, docs array<{kind}>, n array<long>, doc array<int>, term array<int>, tf array<int>")


def _rows(batches) -> Iterator[dict]:
    """Rows of ranges: numbers as arrays, ids as a list."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: v[i].as_py() if c in ("range", "docs") else v[i].values.to_numpy() for c, v in zip(batch.schema.names, batch.columns, strict=True)}


def statistics(ranges: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, words, and the documents that hold each term: a row a term reaches the driver, which a block bounds."""

    def run(batches):
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for row in _rows(batches):
            docs, total = docs + len(row["n"]), total + int(row["n"].sum())
            df += np.bincount(row["term"], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *at.tolist()], pa.int64()), "df": pa.array([docs, total, *df[at].tolist()], pa.int64())})

    found = {r["term"]: r["df"] for r in ranges.select("n", "term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(n_terms)], np.int64)


class MaxTree:
    """For a range of documents and each term the largest score that a document below a node gets from the term."""

    def __init__(self, row: dict, weights: np.ndarray, docs: int, total: int):
        self.docs, n = row["docs"], row["n"]
        doc, term, tf = (row[c].astype(np.int64) for c in ("doc", "term", "tf"))
        length = 100 - 50 + (50 * n * docs) // total
        leaves = np.zeros((len(n), len(weights)), np.int64)
        leaves[doc, term] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc]))
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN_OUT), axis=0))

    def bound(self, terms: np.ndarray) -> int:
        return int(self.levels[-1][0, terms].sum())

    def best(self, terms: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(document, score) of those that can be among the k best with at least `least`, highest first, ties whole.

        Always opens the node of the highest bound; ends where that is below the k-th score found, so that
        nodes of an equal bound are opened still, as they may hold a document that wins a tie.
        """
        heap, found = [(-self.bound(terms), len(self.levels) - 1, 0)], []
        while heap and -heap[0][0] >= least:
            bound, level, node = heapq.heappop(heap)
            if level == 0:
                found.append((node, -bound))
                if len(found) == k:
                    least = -bound
                continue
            begin = node * FAN_OUT
            bounds = self.levels[level - 1][begin : begin + FAN_OUT, terms].sum(1)
            for child in np.flatnonzero(bounds >= least).tolist():
                heapq.heappush(heap, (-int(bounds[child]), level - 1, begin + child))
        return found


def _search(ranges: DataFrame, queries: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(query, doc, score) that holds the k best of each query of a block, and some more."""
    kind = ranges.schema["docs"].dataType.elementType.simpleString()
    ordered = kind in ORDERED

    def trees(batches):
        for row in _rows(batches):
            yield row["range"], MaxTree(row, weights, docs, total)

    def bounds(batches):
        kept: list[list[tuple[int, int]]] = [[] for _ in queries]
        for at, tree in trees(batches):
            for q, terms in enumerate(queries):
                if bound := tree.bound(terms):
                    kept[q] = heapq.nlargest(FIRST, [*kept[q], (bound, at)])
        rows = [(q, bound, at) for q, own in enumerate(kept) for bound, at in own]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("query", pa.int32()), ("bound", pa.int64()), ("range", pa.int64())))})

    def opener(wanted: dict[int, list[int]] | None, opened: dict[int, set[int]], least: dict[int, int]):
        def run(batches):
            for batch in batches:
                out = []
                for at, tree in trees([batch]):
                    for q in wanted[at] if wanted is not None else range(len(queries)):
                        if q not in opened.get(at, ()):
                            best = [(q, tree.docs[doc], score) for doc, score in tree.best(queries[q], k, least.get(q, 1))]
                            # Many documents may tie; the least ids of them are enough.
                            out += sorted(best, key=lambda x: (-x[2], x[1] is None, x[1]))[:k] if ordered and len(best) > k else best
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("query", pa.int32()), ("doc", batch.schema.field("docs").type.value_type), ("score", pa.int64())))})

        return run

    schema = f"query int, doc {kind}, score long"
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "range")
    first = ranges.mapInArrow(bounds, "query int, bound long, range long").withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= FIRST).select("query", "range").collect()
    wanted: dict[int, list[int]] = {}
    for r in first:
        wanted.setdefault(r["range"], []).append(r["query"])
    begun = common.table(ranges.where(F.col("range").isin(list(wanted))).mapInArrow(opener(wanted, {}, {}), schema), "search-first")
    # The k-th score of these documents: no document below it can be among the k best.
    ranked = begun.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    least = {r["query"]: r["score"] for r in ranked.where(F.col("at") == k).select("query", "score").collect()}
    rest = ranges.mapInArrow(opener(None, {at: set(q) for at, q in wanted.items()}, least), schema)
    return begun.unionByName(rest)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Queries with a word, in blocks of which each has at most BLOCK_QUERIES and, but for one long query, BLOCK_TERMS."""
    block, terms = [], set()
    for row in queries.toLocalIterator():
        own = set(words(bytes(row["text"] or b"")))
        if block and (len(block) == BLOCK_QUERIES or len(terms | own) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        if own:
            block.append((row["id"], own))
            terms |= own
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_key, rank, key, score): each query's k highest-scoring documents with a score above 0.

    Scores are whole numbers. A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), a document's
    length m is 50 + 50 n N div L, and each different term of a query adds weight * (10^9 tf div (1000 tf + 20 m)).

    The asked terms' counts are written once, a row a range of documents. Over each range stands a tree of
    maxima: a node has the highest score that each term gives to a document below it, so that their sum over
    a query's terms bounds all these documents. Every query opens its FIRST best ranges; the k-th score
    found there closes what has a lower bound in all others. Queries are a stated set: the driver reads
    them one by one and searches blocks of them (BLOCK_QUERIES, BLOCK_TERMS), each over all documents.

    Equal scores are ordered by ascending key, null keys last. Each row of `queries` is a query, so a
    repeated query_key has its ranks twice; repeated keys and rows of `docs` are documents each. Null or
    wordless texts and queries have no rows; texts of any length count whole. Other columns are not read;
    an empty table gives an empty one.
    """
    spark, kind, query_kind = docs.sparkSession, docs.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    if k < 1:
        raise ValueError("k is 1 or more")
    asked = queries.select(F.col(query_key).alias("id"), F.col(query_text).cast("binary").alias("text"))
    parts = []
    for block in _blocks(asked):
        terms = {t: i for i, t in enumerate(sorted(set().union(*[own for _, own in block])))}
        ranges = common.table(ranges_of(docs, terms, key, text), "search-ranges")
        n_docs, total, df = statistics(ranges, len(terms))
        if not n_docs:
            continue
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        found = _search(ranges, [np.array(sorted(terms[t] for t in own), np.int64) for _, own in block], weights, n_docs, total, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"query int, name {query_kind}")
        parts.append(top.join(F.broadcast(names), "query").select(F.col("name").alias(query_key), "rank", F.col("doc").alias(key), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{query_key}` {query_kind}, rank int, `{key}` {kind}, score long")
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]
