"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

Shingles of a line are all its runs of nine characters, one from every character on; a shorter line is
one shingle. Two lines match if the Jaccard similarity of their shingle sets is at least the threshold.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import forget, table
from sievework.llm.components import connected_components

#: Characters of a shingle, and shingles that one row of the signatures' aggregation takes in.
WIDTH, STRIDE = 9, 8
#: Bands of a signature, and least hashes in a band.
BANDS, ROWS = 6, 3
#: Lines of one band beyond which they are first compared with leaders, and leaders by hash order of such a band.
WIDE, LEADERS = 32, 3
#: Heads of wide bands that all lines of a family of such bands are compared with.
FAMILY = 4
#: 64-bit words of the membership bitmap that tells which lines' texts a check needs.
BITMAP_WORDS = 1 << 18
#: Shingles of all sets together up to which a check of pairs gets the sets by broadcast (4 bytes each), else by a shuffle.
BROADCAST = 8_000_000


def points(bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> list[list[int]]:
    """Points of the 32-bit hash space, a list per band.

    The leading bits tell bands apart and the next ones the rows of a band, the rest is random. So
    points of different bands lie in different parts of the space: only the samples within a band
    of a very short line may coincide, which raises the chance that two lines share the band.
    """
    draw, b_bits, r_bits = random.Random(seed), max(1, (bands - 1).bit_length()), max(1, (rows - 1).bit_length())
    rest = 32 - b_bits - r_bits
    at = lambda b, r: b << (32 - b_bits) | r << rest | draw.getrandbits(rest)
    return [[v - (1 << 32) if (v := at(b, r)) >> 31 else v for r in range(rows)] for b in range(bands)]


def shingle_rows(lines: DataFrame) -> DataFrame:
    """(lh, x0 to x7): rows of the 32-bit hashes of STRIDE shingles of each line, the last one repeated to fill its row.

    UTF-32 has four bytes for every character, so a shingle is cut out at its place without a walk
    through the line, and all of it stays in generated code.
    """
    wide = lines.select("lh", F.encode("line", "UTF-32").alias("w"))
    last = F.greatest(F.octet_length("w") / 4 - WIDTH, F.lit(0)).cast("int")
    at = wide.select("lh", "w", last.alias("last")).select("lh", "w", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("i"))
    cut = lambda j: F.substring(F.col("w"), F.least(F.col("i") + j, F.col("last")) * 4 + 1, F.lit(4 * WIDTH))
    return at.select("lh", *[F.hash(cut(j)).alias(f"x{j}") for j in range(STRIDE)])


def band_keys(lines: DataFrame) -> DataFrame:
    """(lh, bands): a row per different line, with the keys of its bands.

    A signature holds, for each of BANDS * ROWS points, the least of the line's shingle hashes when
    all are XORed with the point: each point orders the hash space anew, so two lines agree there with
    a chance that is their similarity s, and share one of the bands' keys with probability
    1 - (1 - s ** ROWS) ** BANDS at least: 0.987 at 0.8, 0.9996 at 0.9. Tasks take the minima of
    their own lines before anything is shuffled.
    """
    near = lambda p: F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(p)) for j in range(STRIDE)])
    sample = [F.min(near(p)).alias(f"m{b}_{r}") for b, ps in enumerate(points()) for r, p in enumerate(ps)]
    signed = shingle_rows(lines).groupBy("lh").agg(*sample)
    return signed.select("lh", F.array(*[F.xxhash64(F.lit(b), *[f"m{b}_{r}" for r in range(ROWS)]) for b in range(BANDS)]).alias("bands"))


def band_members(bands: DataFrame) -> DataFrame:
    """(band, lh, n, first): the lines of bands that hold several, with their number and the least of them by hash."""
    listed = bands.select("lh", F.explode("bands").alias("band")).repartition("band")
    groups = listed.groupBy("band").agg(F.count("lh").alias("n"), F.min_by("lh", F.xxhash64("lh")).alias("first")).where("n > 1")
    return table(listed.join(groups.hint("shuffle_hash"), "band"), "line-bands")


def led(members: DataFrame, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """((u, v), (band, lh, head)): each line u with the leaders v of its bands, and the members of wide bands with their first leader.

    A band of up to `wide` lines has one leader. A wider one has those that the line whose bands have most
    lines, as the original of a group of near copies has, and the least under LEADERS hash orders are.
    """
    many = members.where(F.col("n") > wide).select("band", "lh", "n")
    shared = many.groupBy("lh").agg(F.sum("n").alias("shared"))
    orders = [F.max_by("lh", F.struct("shared", "lh")), *[F.min_by("lh", F.xxhash64("lh", F.lit(k))) for k in range(LEADERS)]]
    heads = many.join(shared, "lh").groupBy("band").agg(F.array(*orders).alias("heads"))
    many = table(many.join(heads, "band").select("band", "lh", F.get("heads", F.lit(0)).alias("head"), F.array_distinct("heads").alias("heads")), "line-many")
    few = members.where(F.col("n") <= wide).select(F.col("lh").alias("u"), F.col("first").alias("v"))
    stars = few.unionByName(many.select(F.col("lh").alias("u"), F.explode("heads").alias("v"))).where("u <> v").distinct()
    return table(stars, "line-led"), many.select("band", "lh", "head")


def unled(members: DataFrame, found: DataFrame | None = None, wide: int = WIDE) -> DataFrame:
    """(u, v): pairs of a band of up to `wide`, its leader apart, that share no leader whom both match (`found`: u matches leader v)."""
    few = members.where((F.col("n") <= wide) & (F.col("lh") != F.col("first"))).select("band", "lh")
    if found is None:
        few = few.withColumn("leaders", F.array("lh"))
    else:
        own = found.groupBy("u").agg(F.collect_set("v").alias("leaders"))  # a few of each of its bands
        few = few.join(own, F.col("lh") == F.col("u"), "left").select("band", "lh", F.array_append(F.coalesce("leaders", F.array().cast("array<bigint>")), F.col("lh")).alias("leaders"))
    a, b = (few.select("band", F.col("lh").alias(k), F.col("leaders").alias(f"leaders_{k}")) for k in "uv")
    return a.join(b, "band").where("u < v AND NOT arrays_overlap(leaders_u, leaders_v)").select("u", "v").distinct()


def candidates(bands: DataFrame, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """((u, v), (band, lh, head)): pairs of different lines that share a band, and the members of wide bands with their first leader.

    A band of over `wide` lines gives the pairs with its leaders alone; `across` finds the links that these leave out.
    """
    members = band_members(bands)
    stars, many = led(members, wide)
    pairs = unled(members, None, wide).unionByName(stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return pairs.distinct(), many


def shingle_set(line):
    """Array of the different shingles' 32-bit hashes of a line.

    Two different shingles share one with a chance of 2 ** -32, so the similarity of two lines of n
    shingles is off by n / 2 ** 32 at most on average.
    """
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.octet_length(w) - 4 * WIDTH, F.lit(0)) + 1, F.lit(4))
    cut = lambda w: F.transform(starts(w), lambda at: F.hash(F.substring(w, at, F.lit(4 * WIDTH))))
    each = F.transform(F.array(F.encode(line, "UTF-32")), cut)
    return F.array_distinct(F.get(each, F.lit(0)))


def listed(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """`rows` with a column listed: false where column `name` is none of `ids`; true where it is one, and for hardly any others.

    A bitmap of fixed size (BITMAP_WORDS rows, so it is broadcast) tells, so no row is shuffled.
    """
    one, slot = F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) AS int))"), F.expr(f"pmod(shiftright(`{name}`, 6), {BITMAP_WORDS})")
    bitmap = ids.select(name).groupBy(slot.alias("slot")).agg(F.bit_or(one).alias("bits"))
    told = rows.withColumn("slot", slot).join(F.broadcast(bitmap), "slot", "left")
    return told.withColumn("listed", F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False))).drop("slot", "bits")


def asked_lines(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """(lh, line) of the lines that `asked` (lh, in one row or several) names.

    The scan passes on hardly any lines but those (see `listed`).
    """
    ids = asked.select("lh").distinct()
    asked = listed(lines, ids, "lh").where("listed").groupBy("lh").agg(F.min("line").alias("line"))
    return asked.join(ids, "lh", "left_semi")


def shingle_sets(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(lh, s): the different shingles' hashes of the lines that pairs name."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("lh"))
    return asked_lines(asked, lines).select("lh", shingle_set(F.col("line")).alias("s"))


def alike(a, b, threshold: float):
    """Whether two sets have a Jaccard similarity of at least `threshold`; their sizes tell first, and what they share is counted once."""
    n_a, n_b, eps = F.size(a), F.size(b), 1e-9
    sized = (n_a >= threshold * n_b - eps) & (n_b >= threshold * n_a - eps)
    return sized & (F.size(F.array_intersect(a, b)) >= threshold / (1 + threshold) * (n_a + n_b) - eps)


def matches(pairs: DataFrame, sets: DataFrame, threshold: float, hint: str = "shuffle_hash") -> DataFrame:
    """Those of the pairs whose shingle sets (lh, s) have a Jaccard similarity of at least `threshold`.

    Hash joins, as a sort would move the sets once more.
    """
    a, b = (sets.select(F.col("lh").alias(k), F.col("s").alias(f"s_{k}")).hint(hint) for k in "uv")
    return pairs.join(a, "u").join(b, "v").where(alike(F.col("s_u"), F.col("s_v"), threshold)).select(*pairs.columns)


def led_matches(stars: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, leader v) whose lines (lh, line) match.

    A set of shingles takes several times the room of its line, so lines are shuffled and make their sets where
    they meet the leaders; only the leaders' sets are made before.
    """
    leaders = texts.join(stars.select(F.col("v").alias("lh")).distinct(), "lh", "left_semi").select(F.col("lh").alias("v"), shingle_set(F.col("line")).alias("s_v"))
    both = stars.join(texts.select(F.col("lh").alias("u"), "line").hint("shuffle_hash"), "u").join(leaders.hint("shuffle_hash"), "v")
    own = F.array(shingle_set(F.col("line")))  # bound by a lambda, as it would be made anew for each use
    return both.where(F.exists(own, lambda s: alike(s, F.col("s_v"), threshold))).select("u", "v")


def across(many: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of components that a match between two lines of wide bands (band, lh, head) joins.

    Bands whose lines one component holds are done. In the others a line stands for what tells it
    from its band's head: the d shingles that one of both has and the other lacks. No match within a band is lost;
    lines also meet the FAMILY heads of most lines among those that share lines with theirs, if they are half like
    them, so most matches that share no band are found too. Two lines of n shingles
    match if their sets differ in at most r * (n_u + n_v) shingles, r = (1 - threshold) / (1 + threshold); that
    is d_u + d_v less twice what these differences have in common. Lines that match the head are linked to
    it, so of any other pair one line has d > r * (n + n_head), and the pair must share many differences, while
    copies with edits of their own share few. A prefix filter finds those pairs: with all differences
    in one order, they share one of the first d - o + 1, o the least that a line must share with any
    partner. Differences that one component alone holds come first in that order, as none of them is shared with
    another component; so a line with too many of them meets nobody, and the place of a shared one bounds
    what two lines have in common. The others come by rarity. Lines of one component are not compared,
    so a group of near copies gives no pairs of its own.
    """
    from pyspark.sql import Window

    r, eps = (1 - threshold) / (1 + threshold), 1e-9
    placed = many.join(nodes, F.col("lh") == F.col("node"), "left").select("band", "head", "lh", F.coalesce("component", "lh").alias("c"))
    placed = table(placed, "line-wide")
    divided = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("top")).where("low < top").select("band")
    left = table(placed.join(divided, "band", "left_semi").select("head", "lh", "c").distinct(), "line-divided")
    several = left.groupBy("lh").agg(F.min("head").alias("low"), F.max("head").alias("top")).where("low < top").select("lh", "low")
    families = connected_components(left.join(several, "lh").select(F.col("head").alias("u"), F.col("low").alias("v")).distinct())
    left = left.join(families, F.col("head") == F.col("node"), "left").select("head", "lh", "c", F.coalesce("component", "head").alias("family"))
    ranked = left.groupBy("family", "head").agg(F.count("*").alias("k")).withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("k"), "head")))
    chief = ranked.where(F.col("rank") <= FAMILY).select("family", "head")
    lined = table(left.select("lh", "c", "family").distinct().join(sets, "lh"), "line-open")
    left = table(left.join(_alone(lined, chief, threshold), "lh", "left_anti"), "line-left")
    more = left.select("lh", "c", "family").distinct().join(chief, "family")
    met_by = left.select("head", "lh", "c", F.lit(True).alias("banded")).unionByName(more.select("head", "lh", "c", F.lit(False).alias("banded")))
    met_by = met_by.groupBy("head", "lh", "c").agg(F.max("banded").alias("banded"))
    lined = lined.drop("family")
    heads = lined.select(F.col("lh").alias("head"), F.col("c").alias("c_head"), F.col("s").alias("s_head")).join(left.select("head").distinct(), "head", "left_semi")  # a head is a line of its band
    join = "broadcast" if (heads.agg(F.sum(F.size("s_head"))).first()[0] or 0) <= BROADCAST else "shuffle_hash"
    n, n_head = F.size("s"), F.size("s_head")
    half = F.size(F.array_intersect("s", "s_head")) >= (n + n_head) / 4
    met_by = table(met_by.join(lined.drop("c"), "lh").join(heads.hint(join), "head").where(F.col("banded") | half).select("head", "lh", "c"), "line-met-by")
    met_by = _fewer_heads(met_by, ranked)
    apart = met_by.join(lined.drop("c"), "lh").join(heads.hint(join), "head")
    apart = apart.select("head", "lh", "c", "c_head", n.alias("n"), n_head.alias("n_head"), F.concat(F.array_except("s", "s_head"), F.array_except("s_head", "s")).alias("e"))
    d = F.size("e")
    n, n_head = F.col("n"), F.col("n_head")
    near = F.col("d") <= r * (n + n_head) + eps
    apart = table(apart.withColumn("d", d).withColumn("near", near), "line-apart")
    straight = apart.where(F.col("near") & (F.col("c") != F.col("c_head"))).select(F.col("lh").alias("u"), F.col("head").alias("v"), F.col("c").alias("c_u"), F.col("c_head").alias("c_v"))
    apart = apart.withColumn("c", F.when(F.col("near"), F.col("c_head")).otherwise(F.col("c")))
    inside = F.ceil((F.col("d") + r * (n_head - n)) / 2 - eps)  # its partners neither match the head nor are in its component
    least = F.greatest(F.lit(1), F.ceil(F.col("d") - r * (n + F.floor(n / threshold + eps)) - eps), F.when(F.col("c") == F.col("c_head"), inside))
    each = apart.withColumn("o", least).where("o <= d").select("head", "lh", "c", "n", "d", "o", F.explode("e").alias("x"))
    # Lines outside a difference's largest component look for partners; that component's own do not meet.
    same = Window.partitionBy("head", "x")
    shared = each.repartition("head", "x").withColumn("k", F.count("*").over(Window.partitionBy("head", "x", "c")))
    shared = shared.select("*", F.max_by("c", F.struct("k", "c")).over(same).alias("main"), F.count("*").over(same).alias("used"), (F.min("c").over(same) < F.max("c").over(same)).alias("several")).where("several")
    line = Window.partitionBy("head", "lh")
    at = F.col("d") - F.count("*").over(line) + F.row_number().over(line.orderBy("used", "x")) - 1
    firsts = shared.select("head", "x", "main", "lh", "c", "n", "d", "o", at.alias("at")).where("at <= d - o")
    firsts = table(firsts, "line-firsts")
    a, b = (firsts.select("head", "x", "main", F.col("lh").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("c", "n", "d", "at")]) for k in "uv")
    a = a.where("c_u <> main").drop("main")
    most = F.least(F.col("d_u") - F.col("at_u"), F.col("d_v") - F.col("at_v"))  # what they share from here on
    met = a.join(b, ["head", "x"]).where((F.col("c_u") != F.col("c_v")) & ((F.col("c_v") == F.col("main")) | (F.col("u") < F.col("v"))))
    met = met.where(F.col("d_u") + F.col("d_v") - 2 * most <= r * (F.col("n_u") + F.col("n_v")) + eps).select("u", "v", "c_u", "c_v")
    met = met.unionByName(straight).distinct()
    lined = lined.select("lh", "s")
    size = lined.agg(F.sum(F.size("s"))).first()[0] or 0
    found = matches(met, lined, threshold, "broadcast" if size <= BROADCAST else "shuffle_hash")
    return found.select(F.col("c_u").alias("u"), F.col("c_v").alias("v")).distinct()


def _fewer_heads(met_by: DataFrame, ranked: DataFrame) -> DataFrame:
    """`met_by` (head, lh, c) with heads that stand for others: a head gives its lines to the first that half of them meet too.

    Lines that met under a head still meet under the one that stands for it, so no pair is lost, and a line
    of a family with several heads has hardly more than one row.
    """
    order = ranked.select("head", "family", "rank")
    at = met_by.join(order, "head")
    sizes = at.groupBy("head").agg(F.count("*").alias("held"))
    both = at.select("lh", "family", "head", "rank").join(at.select("lh", "family", F.col("head").alias("by"), F.col("rank").alias("by_rank")), ["lh", "family"]).where("by_rank < rank")
    likely = both.groupBy("head", "by").agg(F.count("*").alias("k"), F.min("by_rank").alias("by_rank")).join(sizes, "head").where("2 * k >= held").select("head", "by", "by_rank")
    likely = table(likely, "line-likely")  # some rows a head
    roots = likely.join(likely.select(F.col("head").alias("by")).distinct(), "by", "left_anti")
    stands = roots.groupBy("head").agg(F.min_by("by", "by_rank").alias("by"))
    return met_by.join(stands, "head", "left").select(F.coalesce("by", "head").alias("head"), "lh", "c").distinct()


def _alone(lined: DataFrame, chief: DataFrame, threshold: float) -> DataFrame:
    """(lh): lines (lh, c, family, s) that can match no other of their family, as too many of their shingles are theirs alone.

    A match of n shingles shares threshold * n at least. What the family's chief heads hold is not counted, so few shingles are listed.
    """
    known = chief.join(lined.select(F.col("lh").alias("head"), "s"), "head").groupBy("family").agg(F.flatten(F.collect_list("s")).alias("known"))  # FAMILY sets at most
    bound, none = (1 - threshold) * F.size("s"), F.array().cast("array<int>")
    own = lined.join(known, "family", "left").select("family", "lh", bound.alias("bound"), F.array_except("s", F.coalesce("known", none)).alias("e"))
    # Only lines with more such shingles than that can go: where they are the few, all stay, as listing costs more.
    many = own.groupBy("family").agg(F.avg((F.size("e") > F.col("bound")).cast("int")).alias("may")).where("may >= 0.5")
    own = own.join(many, "family", "left_semi")
    listed = own.select("family", "lh", "bound", F.explode("e").alias("x")).groupBy("family", "x")
    single = listed.agg(F.min("lh").alias("lh"), F.max("lh").alias("other"), F.min("bound").alias("bound")).where("lh = other")
    return single.groupBy("lh").agg(F.count("*").alias("k"), F.min("bound").alias("bound")).where(F.col("k") > F.col("bound") + 1e-9).select("lh")


def line_components(lines: DataFrame, threshold: float = 0.8, wide: int = WIDE) -> DataFrame:
    """(node, component) of every line (lh, line) that matches another; lh is a line's hash."""
    bands = table(band_keys(lines), "line-signatures")
    members = band_members(bands)
    forget(bands)
    stars, many = led(members, wide)
    texts = table(asked_lines(members, lines), "line-texts")
    found = table(led_matches(stars, texts, threshold), "line-found")
    rest = table(unled(members, found, wide), "line-pairs")
    forget(members)
    asked = rest.select(F.explode(F.array("u", "v")).alias("lh")).distinct()
    set_of = lambda ids: texts.join(ids, "lh", "left_semi").select("lh", shingle_set(F.col("line")).alias("s"))
    more = matches(rest, table(set_of(asked), "line-sets"), threshold)
    nodes = connected_components(found.unionByName(more))
    joined = table(across(many, nodes, set_of(many), threshold), "line-joined")
    for done in (stars, texts, found, rest):
        forget(done)
    return lifted(nodes, joined)


def lifted(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """Components (node, component) after links (u, v) between components have joined some of them; what was no node is one of its own."""
    if joined.isEmpty():
        return nodes
    upper = connected_components(joined).withColumnsRenamed({"node": "part", "component": "whole"})
    moved = nodes.join(upper, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    return moved.unionByName(upper.join(nodes, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component")))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each text's lines thinned, and n_lines and n_dropped beside all its columns.

    Equal and matching lines form components (matching is transitive); of each component the
    occurrence of least key and line number stays. Lines of white space alone stay where they are, and
    so do null and empty texts. Rows that share key and text are one document: a line that the one
    keeps stays in the other too. Null keys come first in the order; an empty table gives an empty one.
    Columns of `docs` named n_lines or n_dropped give way to the operator's own.
    The line number and hash of occurrences are shuffled, not the lines; texts are, once, at the end.
    """
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    lines = rows.select(F.col(key).alias("key"), F.col("__h").alias("h"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(r"\S")).withColumn("lh", F.xxhash64("line"))
    nodes = line_components(lines.select("lh", "line"), threshold)
    seen = lines.select("key", "h", "at", "lh").join(nodes, F.col("lh") == F.col("node"), "left")
    seen = table(seen.select("key", "h", "at", F.coalesce("component", "lh").alias("g")), "line-places")
    place = F.struct("key", "h", "at")
    first = seen.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = seen.join(first, "g").where(~place.eqNullSafe(F.col("first"))).groupBy(F.col("key").alias("k"), "h").agg(F.collect_set("at").alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _thinned(docs.select(*kept), gone, key, text)


def _thinned(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """`docs` without the lines at the places of `gone` (k, h, gone); all columns go through one struct, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rh"))
    out = whole.join(gone, F.col(f"row.{key}").eqNullSafe(F.col("k")) & (F.col("rh") == F.col("h")), "left")
    parted = out.select("row", "gone", F.col(f"row.{text}").alias("value"), F.split(f"row.{text}", "\n").alias("parts"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    thin = F.when(F.col("gone").isNull(), F.col("value")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col("parts"), i)), "\n"))
    n_lines = F.when(F.col("value").isNull(), 0).otherwise(F.size("parts")).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    columns = [thin.alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return parted.select(*columns, n_lines.alias("n_lines"), n_gone.alias("n_dropped"))
