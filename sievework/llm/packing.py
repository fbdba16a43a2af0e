"""Sequence packing by cutting-stock column generation over a histogram of piece lengths."""

from __future__ import annotations

import logging
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import table

#: Lengths are planned in units of this many tokens, rounded up.
UNIT = 8
#: White-space-free chunks whose ids a worker remembers, some 200 bytes each, and documents that it returns at a time.
REMEMBER, ROWS = 600_000, 512
#: Pieces that one task ranks at a time, on average.
RANKED_AT_ONCE = 50_000
#: White space by the Unicode property, which leaves out the separators U+001C to U+001F.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no pre-token crosses it, so a text's ids are those of its
    chunks in a row. Chunks repeat, and so do the lower-cased words in new chunks of ASCII; the library
    sees each word, and each new chunk beyond ASCII, once.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        import re

        self.remember = remember

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: The vocabulary's pre-token pattern, for lower-cased ASCII.
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.split, self.odd = re.compile(_SPACE).split, re.compile("[\x1c-\x1f]").search

    def ids(self, text: str) -> bytes:
        chunks = [c for c in self.split(text) if c] if self.odd(text) else text.split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            pass
        for held in (self.known, self.parts):
            if len(held) > self.remember:
                held.clear()
        new = set(chunks).difference(self.known)
        plain = {c: self.words(c.lower()) for c in new if c.isascii() and "<|" not in c}
        self._learn(self.parts, {w for ws in plain.values() for w in ws}.difference(self.parts))
        for chunk, found in plain.items():
            self.known[chunk] = b"".join([self.parts[w] for w in found])
        self._learn(self.known, new.difference(plain))
        return b"".join(map(self.known.__getitem__, chunks))

    def _learn(self, held: dict[str, bytes], new: set[str]) -> None:
        asked = list(new)
        for text, made in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            held[text] = np.array(made.ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def _chunk_ids(path: str, remember: int) -> ChunkIds:
    return ChunkIds(path, remember)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of every document's pieces, and their ids if asked for.

    A document is cut after every `capacity` ids; only what is left over at its end is shorter.
    A null text counts as empty: its only id is the end id. Null and repeated keys stay.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        ids_of, end = _chunk_ids(path, remember).ids, np.array([end_id], "<u4").tobytes()
        for b in (whole[i : i + ROWS] for whole in batches for i in range(0, max(len(whole), 1), ROWS)):
            keys, starts, sizes, crcs, totals, held = [], [], [], [], [], []
            for k, value in zip(b["key"].astype(object).where(b["key"].notna(), None), b["text"], strict=True):
                ids = ids_of(value or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    keys.append(k)
                    starts.append(start)
                    sizes.append(size)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + size)]))
                    totals.append(n)
                    if with_ids:
                        held.append(np.frombuffer(ids[4 * start : 4 * (start + size)], "<u4").astype(np.int32))
            out = {"key": pd.array(keys, dtype="object"), "start": starts, "length": sizes, "ids_crc32": crcs, "doc_tokens": totals}
            yield pd.DataFrame(out | ({"ids": held} if with_ids else {}))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInPandas(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else ""))
    return made.withColumnRenamed("key", key)


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits the capacity, by dynamic programming over capacities."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    dense, number = np.full(capacity + 1, -1.0), np.full(capacity + 1, -1)
    dense[sizes], number[sizes] = prices, np.arange(len(sizes))
    for room in range(1, capacity + 1):
        value = dense[1 : room + 1] + best[room - 1 :: -1] if room > 1 else dense[1:2] + best[:1]
        i = value.argmax()
        if value[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = value[i], number[i + 1]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return best[capacity], pattern


def plan_patterns(histogram: dict[int, int], capacity: int, gap: float = 3e-3, rounds: int = 4_000) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: how many})] that hold exactly the histogram's pieces, few sequences in all.

    The linear program over patterns is solved by the revised simplex method, one column at a time
    from the knapsack's prices, until the bound shows it within `gap` of its optimum. The solution is
    rounded down, and what is left (fewer pieces than patterns times pieces in one, whatever the
    corpus) is packed best fit first, longest piece first.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([histogram[s] for s in sizes], np.float64)
    fits = capacity // sizes
    basis = np.diag(fits.astype(np.float64))
    inverse, use = np.diag(1.0 / fits), need / fits
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = _best_pattern(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        column = inverse @ pattern
        able = column > 1e-9
        if not able.any():
            break
        ratio = np.where(able, use / np.where(able, column, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * column, 0)
        use[out] = ratio[out]
        basis[:, out] = pattern
        # No fresh inverse: threaded LAPACK can hang in a driver, and rounding errs on the exact side.
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    else:
        logging.getLogger(__name__).warning("column generation ended after %d rounds, at most %.4f times the linear program's optimum", rounds, value)
    left = need.astype(np.int64)
    made: list[tuple[int, dict[int, int]]] = []
    for j in np.argsort(-use, kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        on = pattern > 0
        times = int(min(np.floor(use[j] + 1e-9), (left[on] // pattern[on]).min()))
        if times > 0:
            left[on] -= times * pattern[on]
            made.append((times, {int(s): int(n) for s, n in zip(sizes[on], pattern[on], strict=True)}))
    open_bins: list[list] = []  # room, content
    for size, n in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            fitting = [b for b in open_bins if b[0] >= size]
            bin_ = min(fitting, key=lambda b: b[0]) if fitting else None
            if bin_ is None:
                open_bins.append(bin_ := [capacity, {}])
            bin_[0] -= size
            bin_[1][size] = bin_[1].get(size, 0) + 1
    return made + [(1, content) for _, content in open_bins]


def pack(pieces: DataFrame, capacity: int = 4096, key: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """`pieces` with sequence_id and offset: every piece in one sequence of at most `capacity` tokens.

    Only the histogram of lengths (at most capacity / unit rows) goes to the driver, and only the
    plan (as many patterns) comes back. Pieces of a length class are ranked by (class, bucket)
    counts, so a class with most of the rows is spread over many tasks; rank and plan give the
    sequence, and a sequence's pieces, at most capacity / unit, get their offsets in one window.
    `pieces` needs a stable source, as it is read twice. Pieces of equal key and start are ranked in
    some order; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    sized = pieces.withColumn("__c", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["__c"]: r["n"] for r in sized.groupBy("__c").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    plan = plan_patterns(histogram, capacity // unit)
    lanes, taken, base = [], {}, 0
    for times, content in plan:
        for size, n in content.items():
            at = taken.get(size, 0)
            lanes.append((size, at, at + times * n, base, n))
            taken[size] = at + times * n
        base += times
    lanes = spark.createDataFrame(lanes, "__c int, first long, past long, base long, each long")
    buckets = max(8, total // RANKED_AT_ONCE)
    dealt = sized.withColumn("__b", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("__c", "__b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__c", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__c", "__b").orderBy(key, "start", "ids_crc32")
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, ["__c", "__b"]).withColumn("__r", F.col("__r") + F.col("__o"))
    # The plan's rows are bounded by the number of classes times pieces per sequence, not by the corpus.
    placed = ranked.join(F.broadcast(lanes), "__c").where((F.col("__r") >= F.col("first")) & (F.col("__r") < F.col("past")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("__r") - F.col("first")) / F.col("each")))
    sequence = Window.partitionBy("sequence_id").orderBy(F.desc("__c"), "__r").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(sequence), F.lit(0)).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """Tokenised pieces of all documents, packed, each with its ids: see `pieces_of` and `pack`.

    The plan and the places are made of narrow columns, which name a piece by its file's position; the
    ids join their piece's place at the end, once. Without ids the narrow rows are all that is written.
    """
    made = table(pieces_of(docs, path, capacity, end_id, key, text, with_ids, remember).withColumn("__piece", F.monotonically_increasing_id()), "pack-pieces")
    placed = pack(made.drop("ids"), capacity, key)
    if not with_ids:
        return placed.drop("__piece")
    return placed.join(made.select(F.col("__piece").alias("__own"), "ids"), F.col("__piece") == F.col("__own")).drop("__piece", "__own")


def sequences(packed: DataFrame, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids, n_tokens) of packed pieces: their ids in the order of offsets, padded with the end id to the capacity."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    padding = F.array_repeat(F.lit(end_id), (F.lit(capacity) - F.col("n_tokens")).cast("int"))
    return held.select("sequence_id", F.concat(ids, padding).alias("ids"), "n_tokens")
