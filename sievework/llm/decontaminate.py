"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import table, words

#: Windows that one pass over the documents' words looks for, so what a pass broadcasts is bounded; more take more passes.
WINDOWS_PER_PASS = 40_000


def windows(items: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(item, w): every run of `width` consecutive words of an item; a shorter item with words is one window."""
    split = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("w")).distinct()


def _found(docs: DataFrame, wins: DataFrame, width: int) -> DataFrame:
    """(key, h, item, start, size): occurrences of a pass's windows in documents (key, h, all)."""
    vocabulary = wins.select(F.explode("w").alias("x")).distinct()  # at most width words for each window of a pass
    # How often each benchmark word occurs in all documents: the order by rarity.
    counts = docs.select(F.explode("all").alias("x")).join(F.broadcast(vocabulary), "x", "left_semi").groupBy("x").agg(F.count("*").alias("n"))
    placed = wins.select("item", "w", F.posexplode("w").alias("at", "x"))
    ranked = placed.join(counts, "x", "left").groupBy("item", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x", "at")).alias("rare"))
    # A window occurs only where its rarest word does: with whole containment one prefix token is enough.
    keyed = table(ranked.where("rare.n > 0").select("item", "w", F.col("rare.x").alias("token"), F.col("rare.at").alias("at")), "leak-windows")
    # Words meet the pass's windows in generated code; only those at a prefix token look at the words around them.
    met = docs.select("key", "h", "all", F.posexplode("all").alias("i", "x")).join(F.broadcast(keyed), F.col("x") == F.col("token"))
    start = F.col("i") - F.col("at")
    inside = (start >= 0) & (start + F.size("w") <= F.size("all"))  # positional bounds
    same = F.slice("all", F.greatest(start, F.lit(0)) + 1, F.size("w")) == F.col("w")
    return met.where(inside & same).select("key", "h", "item", start.alias("start"), F.size("w").alias("size")).distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated) of every row of `docs`.

    n_hit counts words inside any occurrence of a window of an item; `items` are the ids of items
    with an occurring window, as strings, sorted. Null texts and texts without words have no words
    and no hits; such items have no window. Null keys stay, repeated rows give repeated rows, rows
    that share key and text share their result; without items nothing is hit; other columns are not
    read; very long texts are taken whole. Documents are cut into words once and kept; windows are taken
    in passes of a bounded number, each over all documents' words.
    """
    return _marked(docs, items, width, key, text, item_key, item_text).drop("__h")


def _marked(docs: DataFrame, items: DataFrame, width: int, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """`contamination` with each text's hash, __h."""
    rows = table(docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), words(F.col(text)).alias("all")), "leak-words")
    wins = table(windows(items, width, item_key, item_text), "leak-items")
    passes = max(1, -(-wins.count() // WINDOWS_PER_PASS))
    parts = [wins.where(F.pmod(F.xxhash64("item", "w"), F.lit(passes)) == p) if passes > 1 else wins for p in range(passes)]
    found = table(reduce(DataFrame.unionByName, [_found(rows, p, width) for p in parts]), "leak-found")
    base = rows.select("key", "h", F.size("all").cast("long").alias("n_words"))
    spread = found.select("key", "h", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    hit = spread.groupBy("key", "h").agg(F.count("*").alias("n_hit"))
    of_items = found.select("key", "h", "item").distinct().groupBy("key", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = hit.alias("a").join(of_items.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.h") == F.col("b.h"))).select("a.key", "a.h", "n_hit", "items")
    joined = base.alias("d").join(both.alias("r"), F.col("d.key").eqNullSafe(F.col("r.key")) & (F.col("d.h") == F.col("r.h")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("d.key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.col("d.h").alias("__h"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of an item; rows that share a key, null too, are judged by their own texts."""
    bad = _marked(docs, items, width, key, text, item_key, item_text).where("contaminated").select(F.col(key).alias("__bad"), F.col("__h").alias("__bad_h")).distinct()
    h = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]) & (h == bad["__bad_h"]), "left_anti")
