"""SimHash near-duplicates: fingerprints, pigeonring candidates, links, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import forget, table
from sievework.llm.components import connected_components
from sievework.llm.line_dedup import across, asked_lines, lifted, listed, matches

BITS = 64
#: Wide fingerprints: 64-bit words, and bits of a segment, each of which is chained with a least hash.
WORDS, SEGMENT = 4, 8
#: Texts that a task remembers to have signed; those met again later are signed again.
SIGNED = 1 << 16
#: Fingerprints with one key beyond which a key's links are found through shared variants, not pairs.
WIDE = 64
#: The same for the keys of texts, whose other links `line_dedup.across` finds.
CROWD = 8
#: Share of a text's shingles by which its first ones are more than a link needs, and by which more of them must be shared.
SPARE = 0.1
#: Groups that hashes are dealt to, at least, to find those that several texts hold; a power of two.
BUCKETS = 256
#: Hashes that a task packs together.
TOGETHER = 1 << 18
#: Longest word whose hash is a sum over its bytes; longer ones take XXH64.
LONG = 64
#: What texts with a word match, as `shingle_hashes` takes words.
WORDED = r"[^\x20\x09-\x0D]"


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of words, repeats included; fewer words are one shingle, none give none."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return []
    line, starts, ends, here = b" ".join(words), [], [], 0
    for w in words:
        starts.append(here)
        here += len(w)
        ends.append(here)
        here += 1
    return [h64(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [h64(line, seed)]


def fingerprints_of(texts: list[str], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text: a bit is 1 if over half of the shingles' hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    for at, text in enumerate(texts):
        hashes = shingle_hashes(text, shingle, seed)
        ones, n = np.zeros(BITS, np.int64), len(hashes)
        if not n:
            continue
        for k in range(0, n, 1 << 14):  # a very long text in parts
            part = np.array(hashes[k : k + (1 << 14)], "<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[at] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row of `docs`; a null or wordless text has fingerprint zero."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "fp": fingerprints_of(b["text"].fillna("").tolist())})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, fp long")
    return rows.select(F.col("key").alias(key), "fp")


def segments(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of `parts` segments in ring order."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits: int) -> int:
    value = (1 << bits) - 1
    return value - (1 << 64) if value >= 1 << 63 else value


def _segment(col, seg):
    return F.shiftrightunsigned(col, seg[0]).bitwiseAND(F.lit(_mask(seg[1])).cast("long"))


def _chain_holds(x, start: int, ring: list, distance: int):
    """Whether the chain that begins at `start` keeps to its budget at every length (x: differing bits)."""
    total, holds = F.lit(0), F.lit(True)
    for length in range(1, len(ring) + 1):
        total = total + F.bit_count(_segment(x, ring[(start + length - 1) % len(ring)]))
        holds = holds & (total <= length * distance // len(ring))
    return holds


def links(prints: DataFrame, distance: int = 2, parts: int = 5, wide: int = WIDE) -> DataFrame:
    """(u, v) of distinct fingerprints whose links join all fingerprints within `distance` bits.

    Pigeonring: of `parts` segments on a ring, two such fingerprints have a start from which every
    chain of l segments differs by at most l * distance / parts bits. With two bits and five segments
    a chain begins with two equal segments: those (about 26 bits) are the key that candidates share,
    and the longer chains prune before the whole distance is taken. A key with over `wide`
    fingerprints emits no pairs: each member lists itself and its one-bit variants outside the
    key, and members that share a variant, which is exactly those within two bits, hang on the
    least one. So both ways find the same components, and rows stay linear in the members.
    """
    if distance != 2:
        raise ValueError("variants of one bit stand for a distance of two")
    ring = segments(parts)
    same = 1
    while (same + 1) * distance // parts == 0:
        same += 1
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.xxhash64(F.lit(s), *[_segment(F.col("fp"), ring[(s + j) % parts]) for j in range(same)]) for s in range(parts)])).alias("start", "key"),
    )
    keyed = table(keyed, "simhash-keys")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, ["start", "key"])
    few = members.where(F.col("n") <= wide)
    a, b = few.select("start", "key", F.col("fp").alias("u")), few.select("start", "key", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    tests = [F.when(F.col("start") == s, _chain_holds(x, s, ring, distance)) for s in range(parts)]
    near = a.join(b, ["start", "key"]).where(F.col("u") < F.col("v")).where(F.coalesce(*tests)).where(F.bit_count(x) <= distance).select("u", "v")
    flips = []
    for s in range(parts):
        inside = {(s + j) % parts for j in range(same)}
        bits = [ring[i][0] + j for i in range(parts) if i not in inside for j in range(ring[i][1])]
        ones = [0] + [(1 << k) - (1 << 64) if k == 63 else 1 << k for k in bits]
        flips.append(F.when(F.col("start") == s, F.array(*[F.lit(o).cast("long") for o in ones])))
    many = members.where(F.col("n") > wide).select("start", "key", "fp", F.explode(F.coalesce(*flips)).alias("flip"))
    many = many.select("start", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    hubs = many.groupBy("start", "key", "variant").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u < top").drop("top")
    star = many.join(hubs, ["start", "key", "variant"]).where("fp <> u").select("u", F.col("fp").alias("v"))
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, parts: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the least key that links reach.

    Equal fingerprints form one class and only classes are compared. Null and wordless texts share
    fingerprint zero and link like any other. A null key gets its class's component but never names
    one (a component of null keys alone is null); repeated keys give repeated rows; other columns
    are not read; an empty table gives an empty one.
    """
    prints = table(fingerprint(docs, key, text), "simhash-prints")
    classes = table(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    nodes = connected_components(links(classes.select("fp"), distance, parts))
    joined = classes.join(nodes, classes.fp == nodes.node)
    best = joined.groupBy("component").agg(F.min("least").alias("best"))
    moved = joined.join(best, "component").select("fp", "best")
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("best", "least").alias("component_id"))
    return prints.join(named, "fp", "left").select(key, "fp", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WORDS * 64 bits, each 1 if over half of the shingles' hashes, spread anew for every word, set it; and for each segment of them the hash that is nearest to a point of its own (XOR distance)."""
    ones = np.zeros(WORDS * BITS, np.int64)
    rng, n = np.random.default_rng(64), WORDS * BITS // SEGMENT
    salts = rng.integers(1, 1 << 63, WORDS, np.uint64)
    points = np.arange(n, dtype=np.uint64) << np.uint64(64 - n.bit_length() + 1) | rng.integers(0, 1 << (64 - n.bit_length() + 1), n, np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 255):  # so many bits add up in one byte
        x = hashes[k : k + 255, None] ^ salts
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        least = np.minimum(least, (hashes[k : k + 255, None] ^ points).min(axis=0))
    return 2 * ones > len(hashes), least


def chains(print_: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each segment: its bits and the leading bits of the hash chained with it, in one long."""
    bits, least = print_
    segment = np.packbits(bits.reshape(len(least), SEGMENT), axis=1)[:, 0].astype(np.uint64)
    # The least hash is a distance with leading zeros: its low bits tell hashes apart.
    return (least << np.uint64(SEGMENT) | segment).view(np.int64)


def wide_candidates(prints: DataFrame, wide: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """((u, v), (band, lh, head)): pairs of texts (h, chains) that may be near-duplicates, and the members of wide keys with a leader.

    Two candidates share a segment and the least hash chained with it, or one of the further keys that
    may follow a text's chains. Texts of similarity s share a least hash with chance s and a segment of SEGMENT bits
    with about 0.27 at 0.8; texts that share no shingle share no key, however many texts there are, so
    keys hold like texts alone and their members grow with the copies. The members of a key with over `wide` texts meet its
    leaders alone, the least under two hash orders; `line_dedup.across` finds the links that leaves out.
    """
    keyed = prints.dropDuplicates(["h"]).select("h", F.posexplode("chains").alias("start", "chain"))
    keyed = keyed.select("h", F.xxhash64(F.least("start", F.lit(WORDS * BITS // SEGMENT)), "chain").alias("key")).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.min_by("h", F.xxhash64("h")).alias("other")).where("n > 1")
    members = table(keyed.join(sizes.hint("shuffle_hash"), "key"), "simhash-wide-keys")
    few, many = members.where(F.col("n") <= wide), members.where(F.col("n") > wide)
    pairs = few.select("key", F.col("h").alias("u")).join(few.select("key", F.col("h").alias("v")), "key").where("u < v").select("u", "v")
    led = many.select("h", F.explode(F.array_distinct(F.array("low", "other"))).alias("head")).where("h <> head")
    found = table(pairs.unionByName(led.select(F.least("h", "head").alias("u"), F.greatest("h", "head").alias("v"))).distinct(), "simhash-wide-pairs")
    crowd = table(many.select(F.col("key").alias("band"), F.col("h").alias("lh"), F.col("other").alias("head")), "simhash-crowd")
    forget(members)
    return found, crowd


def firsts(hashes: np.ndarray, similarity: float, spare: float = 0) -> tuple[np.ndarray, int]:
    """The first of a text's different hashes in their order, and how many of them each partner shares at least.

    A partner shares o = ceil(similarity * n) of n hashes or more, so at most n - o of them are not the
    partner's, and the first n - o + l hold the first l that both share: of either text, with its own l. Of these
    l = 1 + floor(spare * n), and a partner has `o` hashes at least, so 1 + floor(spare * o) are first ones of both.
    """
    n = len(hashes)
    o = int(np.ceil(similarity * n - 1e-9))
    return hashes[: n - o + 1 + int(spare * n)], 1 + int(spare * o)


def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: whether it belongs to a word, and its factor; the factor of each place in a word."""
    draw = np.random.default_rng(42)
    ink = np.ones(256, bool)
    ink[[0x20, *range(0x09, 0x0E)]] = False
    return ink, draw.integers(1, 1 << 63, 256, np.uint64) * ink, draw.integers(1, 1 << 63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)


INK, BYTE, PLACE = _factors()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, as `shingle_hashes` takes words; all words at once."""
    line = text.encode("utf-8", "surrogatepass").lower()
    raw = np.frombuffer(line, np.uint8)
    ink = INK[raw]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(raw), dtype=np.int32)
    place = np.minimum(at - np.maximum.accumulate(np.where(begin, at, 0)), LONG - 1)
    out = np.add.reduceat(BYTE[raw] * PLACE[place], starts)
    if place.max() == LONG - 1:
        import xxhash

        sizes = np.add.reduceat(ink, starts, dtype=np.int64)
        for i in np.flatnonzero(sizes >= LONG):
            out[i] = xxhash.xxh64_intdigest(line[starts[i] : starts[i] + sizes[i]], 42)
    return out


def quick_shingles(text: str, shingle: int) -> np.ndarray:
    """64-bit hashes of the shingles that `shingle_hashes` takes, each mixed from the hashes of its words."""
    each = word_hashes(text)
    size = min(shingle, len(each))
    out = np.full(len(each) - size + 1 if size else 0, size, np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[j : j + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _different(hashes: np.ndarray) -> np.ndarray:
    """The different hashes in their order."""
    out = np.sort(hashes)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def _packed(hs: np.ndarray, needs: np.ndarray, xs: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """Rows (bucket, x, h, need) of packed arrays: the different hashes xs of texts hs, dealt by hash.

    A hash that several of these texts hold is counted for them here and sent once, with need 0, so a hash of very
    many texts is a few; the counts are a row of their own, beyond the buckets.
    """
    text, x = np.repeat(np.arange(len(xs)), [len(v) for v in xs]), np.concatenate(xs)
    order = np.argsort(x)
    x, text = x[order], text[order]
    h, need = hs[text], needs[text]
    shared, starts = _shared(x, h)
    k = np.bincount(text[shared], minlength=len(xs))
    some = np.flatnonzero(k)
    need[shared] = 0
    sent = ~shared
    sent[starts] = True
    x, h, need = x[sent], h[sent], need[sent]
    bucket = (x & np.uint64(buckets - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    x, h, need = (x[order] >> np.uint64(16)).astype(np.uint32), h[order], need[order]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    rows = [(b, x[i:j].tobytes(), h[i:j].tobytes(), need[i:j].tobytes()) for b, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i < j]
    rows.append((buckets + int(hs[0]) % buckets, k[some].astype(np.uint32).tobytes(), hs[some].tobytes(), needs[some].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "x", "h", "need"])


def _shared(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes x of texts h: whether several texts hold it, and where each begins."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    several = np.minimum.reduceat(h, starts) < np.maximum.reduceat(h, starts)
    return np.repeat(several, np.diff(np.append(starts, len(x)))), starts


def sharing(texts: DataFrame, told) -> DataFrame:
    """(h): texts of which at least as many hashes as they need are also other texts'; unlike hashes count as one with a chance of 2 ** -32 or less.

    told() makes, for a task, a function of a batch of `texts` that gives (h, need, different hashes) of each text.
    Packed arrays of hashes are shuffled, by hash, and each bucket finds those of several texts.
    """
    buckets = 1 << max(BUCKETS - 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    buckets = min(buckets, 1 << 15)

    def pack(batches):
        of, held, n = told(), [], 0
        each = (x for b in batches for x in of(b) if len(x[2]))
        for x in each:
            held.append(x)
            n += len(x[2])
            if n >= TOGETHER:
                yield _packed(*_columns(held), buckets)
                held, n = [], 0
        if held:
            yield _packed(*_columns(held), buckets)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        x, h, need = (np.frombuffer(b"".join(group[c]), kind) for c, kind in (("x", np.uint32), ("h", np.int64), ("need", np.uint32)))
        if group["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"h": h, "need": need.astype(np.int64), "k": x.astype(np.int64)})
        order = np.argsort(x, kind="stable")
        x, h, need = x[order], h[order], need[order]
        shared, starts = _shared(x, h)
        shared |= np.repeat(np.minimum.reduceat(need, starts) == 0, np.diff(np.append(starts, len(x))))
        shared &= need > 0
        hs, at, k = np.unique(h[shared], return_index=True, return_counts=True)
        return pd.DataFrame({"h": hs, "need": need[shared][at].astype(np.int64), "k": k})

    packed = texts.mapInPandas(pack, "bucket int, x binary, h binary, need binary")
    counted = packed.groupBy("bucket").applyInPandas(count, "h long, need long, k long")
    return counted.groupBy("h").agg(F.sum("k").alias("k"), F.min("need").alias("need")).where("k >= need").select("h")


def _columns(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    hs, needs, xs = zip(*held, strict=True)
    return np.array(hs, np.int64), np.array(needs, np.uint32), list(xs)


def first_hashes(shingle: int, similarity: float):
    """For `sharing`: of texts (h, text) their first shingle hashes, and how many of them a near-duplicate shares at least."""

    def told():
        seen: set[int] = set()  # a text that many rows of a task hold is signed once

        def of(b):
            for h, value in zip(b["h"], b["text"], strict=True):
                if h not in seen:
                    if len(seen) == SIGNED:
                        seen.clear()
                    seen.add(h)
                    xs, need = firsts(_different(quick_shingles(value, shingle)), similarity, SPARE)
                    yield h, need, xs

        return of

    return told


def set_hashes(similarity: float):
    """For `sharing`: of sets (lh, s) all hashes, and how many of them a near-duplicate shares at least."""

    def told():
        def of(b):
            for h, s in zip(b["lh"], b["s"], strict=True):
                x = np.asarray(s, np.int32).view(np.uint32) * np.uint64(0x9E3779B97F4A7C15)  # 32 bits are too few to be dealt out
                yield h, int(np.ceil(similarity * len(x) - 1e-9)), x ^ (x >> np.uint64(32))

        return of

    return told


def signatures(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(lh, s, keys) of texts (lh, line): the different hashes (32 bits) of the word shingles, and keys of which near-duplicates share one: chains, and first hashes, of which one at least is common."""

    def run(batches):
        for b in batches:
            sets, keys = [], []
            for text in b["line"]:
                hashes = quick_shingles(text, shingle)
                sets.append(_different(hashes.astype(np.uint32)).view(np.int32))
                keys.append(np.concatenate([chains(wide_fingerprint(hashes)), firsts(_different(hashes), similarity)[0].view(np.int64)]))
            yield pd.DataFrame({"lh": b["lh"], "s": sets, "keys": keys})

    return texts.mapInPandas(run, "lh long, s array<int>, keys array<long>")


def near_texts(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of every text (h, text) that has a near-duplicate.

    A text that could be alike has most of its shingles in others. Those that don't are left out: first by
    their first shingles (see `firsts`), then, of those that stay, by all. So a passage of very many texts makes no pairs.
    """
    worded = texts.where(F.col("text").rlike(WORDED))
    alive = table(sharing(worded, first_hashes(shingle, similarity)).select(F.col("h").alias("lh")), "simhash-alive")
    asked = asked_lines(alive, worded.select(F.col("h").alias("lh"), F.col("text").alias("line")))
    signed = table(signatures(asked, shingle, similarity), "simhash-signed")
    left = sharing(signed.select("lh", "s"), set_hashes(similarity))
    left = table(signed.join(left.select(F.col("h").alias("lh")), "lh", "left_semi"), "simhash-sets")
    forget(signed)
    pairs, crowd = wide_candidates(left.select(F.col("lh").alias("h"), F.col("keys").alias("chains")), CROWD)
    sets = left.select("lh", "s")
    nodes = connected_components(matches(pairs, sets, similarity))
    if crowd.isEmpty():
        return nodes
    return lifted(nodes, table(across(crowd, nodes, sets, similarity), "simhash-joined"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` of each group of near-duplicates: that of least key, and of these that of least text hash.

    Near-duplicates are texts whose sets of word shingles have a Jaccard similarity of at least
    `similarity`, and what such links join; none is lost. Texts whose shingles rule out a partner are
    not compared (see `near_texts`). Of the others, SimHash fingerprints of WORDS * 64 bits and prefix filters
    find the candidates (see `wide_candidates`), exact similarities decide. Texts of a wide key that these pairs leave in several components are compared by a
    prefix filter over their exact shingles, so no link between them is lost.
    Rows are told apart by key and text, so null and repeated keys neither lose nor keep a row; a null
    key comes last. Of rows that share both, any one stays. Null and wordless texts are one group. Very
    long texts are taken whole, in parts. Other columns, whatever their names, stay as they are; an
    empty table gives an empty one. Rows that are alone in their group are not shuffled.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    texts = rows.select("h", F.col(f"row.`{text}`").alias("text"))
    nodes = near_texts(texts, shingle, similarity)
    wordless = texts.where(~F.coalesce(F.col("text"), F.lit("")).rlike(WORDED)).select("h", F.lit(0).alias("g")).distinct()
    groups = nodes.select(F.col("node").alias("h"), F.col("component").alias("g")).unionByName(wordless)
    least = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("least"))
    several = table(least.join(groups, "h", "left").where("n > 1 OR g IS NOT NULL").select("h", "least", F.coalesce("g", "h").alias("g")), "simhash-several")
    best = several.groupBy("g").agg(F.min("least").alias("best"))
    best = best.select(F.col("best.k").alias("bk"), F.col("best.h").alias("bh"))
    told = listed(rows, several.select("h"), "h")
    kept = told.where("listed").join(several.select("h"), "h", "left_semi")
    kept = kept.join(best, F.col("k").eqNullSafe(F.col("bk")) & (F.col("h") == F.col("bh")), "left_semi").dropDuplicates(["k", "h"])
    alone = told.where("NOT listed").unionByName(told.where("listed").join(several.select("h"), "h", "left_anti"))
    return alone.unionByName(kept).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def as_hex(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))
