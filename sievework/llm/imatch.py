"""I-Match fingerprints: an IDF band of terms, sorted and distinct, hashed over random lexicon subsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import table

#: Random lexicon subsets per level, and each level's share of the lexicon.
SUBSETS = 32
SHARES = (2.0**-1, 2.0**-3, 2.0**-5, 2.0**-7, 2.0**-9, 2.0**-11)
#: Most terms that the band holds, and the share of documents above which a term is too common for it.
LEXICON = 1_000_000
TOO_COMMON = 0.2
#: Share of a document's terms that the band must hold; a document with less of them there keeps all its terms.
LEAST_HELD = 0.25
_TERM = re.compile(r"\w+")


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's lower-cased words."""
    words = np.array(list(set(_TERM.findall(text.lower()))), object)
    return np.sort(pd.util.hash_array(words, categorize=False)) if len(words) else np.empty(0, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signatures(terms: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """(documents, levels * subsets) of 16-bit signatures; 0: the document has no term in that subset.

    A signature hashes the document's sorted distinct terms that the subset holds, place by place.
    """
    out = np.zeros((len(terms), len(SHARES) * SUBSETS), np.uint16)
    sizes = np.array([len(t) for t in terms])
    if not sizes.sum():
        return out
    every, row = np.concatenate(terms), np.repeat(np.arange(len(terms)), sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    for k in range(SUBSETS):
        held, at, draw = every, row, _mix(every, 2 * k + 1 + (seed << 20))
        for level, share in enumerate(SHARES):
            inside = draw < np.uint64(share * 2.0**64)
            held, at, draw = held[inside], at[inside], draw[inside]
            if not len(held):
                break
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            total = np.add.reduceat(_mix(held, 77) * powers[place], starts)
            out[at[starts], level * SUBSETS + k] = (_mix(total, 5) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the share of equal signatures among subsets that touch either document.

    It is taken at the sparsest level of which at least half of the subsets touch one of the two, or
    else the level of which most do: there a subset holds about one term, and the share nears the
    overlap of the terms. Equal fingerprints have 1, an empty one and another 0.
    """
    if (a == b).all():
        return 1.0
    x, y = a.reshape(len(SHARES), SUBSETS), b.reshape(len(SHARES), SUBSETS)
    touched = ((x != 0) | (y != 0)).sum(axis=1)
    full = np.flatnonzero(2 * touched >= SUBSETS)
    level = full[-1] if len(full) else int(touched.argmax())
    return float(((x[level] == y[level]) & (x[level] != 0)).sum() / max(touched[level], 1))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def lexicon(docs: DataFrame, text: str = "text", most: int = LEXICON, too_common: float = TOO_COMMON) -> np.ndarray:
    """Sorted hashes of the band's terms, from the counts of all documents.

    A term is in the band if at most `too_common` of the documents hold it and at least
    postings / `most` do. As all terms' counts add up to the postings, at most `most` terms pass
    whatever the corpus, so the array that tasks receive is at most 8 bytes times `most`.
    """

    def run(batches):
        n = 0
        for b in batches:
            n += len(b)
            terms, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *[term_hashes(v or "") for v in b["text"]]]), return_counts=True)
            yield pd.DataFrame({"term": pd.array(terms.view(np.int64), "Int64"), "n": counts})
        yield pd.DataFrame({"term": pd.array([None], "Int64"), "n": [n]})

    counts = docs.select(F.col(text).alias("text")).mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = table(counts, "imatch-counts")
    rows = counts.agg(F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("docs"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("postings")).first()
    if not rows["postings"]:
        return np.empty(0, np.uint64)
    floor = max(2, -(-rows["postings"] // most))
    band = counts.where(F.col("term").isNotNull() & (F.col("n") >= floor) & (F.col("n") <= max(2.0, too_common * rows["docs"])))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def in_band(terms: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The terms that the band holds; all terms where it holds less than LEAST_HELD of them.

    So texts without band terms still differ, and members of a family so large that its own words are
    too common for the band are still told by those words.
    """
    if not len(terms) or not len(band):
        return terms
    at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
    held = terms[band[at] == terms]
    return held if len(held) >= LEAST_HELD * len(terms) else terms


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row of `docs`; null and empty texts have the all-zero fingerprint."""
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = signatures([in_band(term_hashes(v or ""), band.value) for v in b["text"]])
            yield pd.DataFrame({"key": b["key"], "fingerprint": [as_text(m) for m in made]})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, fingerprint string")
    return rows.select(F.col("key").alias(key), "fingerprint")


def _in_order(docs: DataFrame, key: str, text: str, rows_per_range: int) -> DataFrame:
    """Rows of each range of keys, descending, and after them (ahead = 1) the row that follows the range.

    Ranges come from the keys' quantiles; null keys form the last one. The row after a range is the first
    of the next range that has any; the last range is followed by the first row. What tasks need to know
    of the ranges is one small array each of edges, first rows and successors, by broadcast: a binary
    search places a key, so nothing in the plan grows with the number of ranges.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = docs.count()
    parts = max(1, min(20_000, n // rows_per_range))
    marks = [i / parts for i in range(1, parts)]
    edges = np.array(sorted(set(docs.agg(F.percentile_approx(key, marks, 10 * parts).alias("q")).first()["q"] or [])) if marks else [])
    context = docs.sparkSession.sparkContext
    held = context.broadcast(edges)

    def below(keys):
        return np.searchsorted(held.value, keys.to_numpy(), side="left") if len(held.value) else np.zeros(len(keys), np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(below(keys), dtype="int32")

    # The first row of a range: its largest key and, of rows with that key, the least text hash.
    ranged = F.when(F.col("key").isNull(), -1).otherwise(range_of(F.coalesce("key", F.lit(0))))
    tops = rows.select("key", "h", ranged.alias("r")).groupBy("r").agg(F.max(F.struct("key", F.bitwise_not("h").alias("nh"))).alias("top")).collect()  # a row per range
    tops = sorted(tops, key=lambda t: -t["r"])
    first, hashes, goes = [None] * (len(edges) + 2), np.zeros(len(edges) + 2, np.int64), np.full(len(edges) + 2, -2)
    for i, t in enumerate(tops):
        before = tops[i - 1]["r"]  # of the first range, the last one
        first[t["r"]], hashes[t["r"]], goes[t["r"]] = t["top"]["key"], ~t["top"]["nh"], before
    known = context.broadcast(([0 if v is None else v for v in first], hashes, goes))

    @F.pandas_udf("struct<r:int,ahead:int,h:long>")
    def spot_of(keys: pd.Series, null: pd.Series) -> pd.DataFrame:
        r = np.where(null.to_numpy(bool), -1, below(keys))
        top, h, to = known.value
        is_top = null.to_numpy(bool) | (np.array(top)[r] == keys.to_numpy())
        return pd.DataFrame({"r": r.astype("int32"), "ahead": np.where(is_top, to[r], -2).astype("int32"), "h": h[r]})

    placed = rows.withColumn("spot", spot_of(F.coalesce("key", F.lit(0)), F.col("key").isNull()))
    own, more = F.struct(F.col("spot.r").alias("r"), F.lit(0).alias("ahead")), F.struct(F.col("spot.ahead").alias("r"), F.lit(1).alias("ahead"))
    spots = F.when((F.col("spot.ahead") >= -1) & (F.col("spot.h") == F.col("h")), F.array(own, more)).otherwise(F.array(own))
    placed = placed.select("key", "text", "h", F.explode(spots).alias("at")).select("key", "text", "h", "at.r", "at.ahead")
    # Several ranges to a task, as hashing deals them unevenly.
    return placed.repartition(max(1, parts // 4), "r").sortWithinPartitions(F.desc("r"), "ahead", F.desc_nulls_last("key"), "h", "text")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_range: int = 1_000) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Documents stand in descending key order (null keys last, equal keys by their texts' hashes); the next of the
    last is the first. The edited text replaces the last third (rounded down) of the code points by
    as many of the next document's first, or all it has. Texts cross the network once, into ranges
    of keys, and tasks read them in order. Null texts count as empty; an only document is its own
    next; an empty table gives an empty one.
    """
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        hold: list[tuple] = []
        last = None  # the latest row whose next is still to come: (range, key, text, terms)

        def flush():
            # A row's next is mostly the row after it: each document is signed once.
            different = {id(t): t for h in hold for t in (h[2], h[5])}
            signed = dict(zip(different, signatures(list(different.values())), strict=True))
            a, c = [signed[id(h[2])] for h in hold], [signed[id(h[5])] for h in hold]
            b = signatures([h[4] for h in hold])
            out = pd.DataFrame(
                {
                    "key": pd.array([h[0] for h in hold], dtype="object"),
                    "n_chars": [h[1] for h in hold],
                    "edited_sha256": [h[3] for h in hold],
                    "fingerprint": [as_text(x) for x in a],
                    "edited_fingerprint": [as_text(x) for x in b],
                    "near_edited": [likeness(x, y) for x, y in zip(a, b, strict=True)],
                    "near_next": [likeness(x, y) for x, y in zip(a, c, strict=True)],
                }
            )
            hold.clear()
            return out

        weight = 0
        for batch in batches:
            keys = batch["key"].astype(object).where(batch["key"].notna(), None)
            for k, value, r, ahead in zip(keys, batch["text"], batch["r"], batch["ahead"], strict=True):
                value = value or ""
                terms = in_band(term_hashes(value), band.value)
                if last is not None and last[0] == r:
                    n = len(last[2])
                    cut = n // 3
                    edited = last[2][: n - cut] + value[:cut]
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    hold.append((last[1], n, last[3], sha, in_band(term_hashes(edited), band.value), terms))
                    weight += n
                last = None if ahead else (r, k, value, terms)
                if weight > 2_000_000 or len(hold) >= 1_000:
                    yield flush()
                    weight = 0
        if hold:
            yield flush()

    rows = _in_order(docs, key, text, rows_per_range)
    made = rows.mapInPandas(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("key", key)
