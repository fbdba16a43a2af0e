"""Prefix trie of conversations: chained digests of turns, a node for each distinct prefix."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import common

#: Turns of a conversation that are chained (and summed) in one go; longer ones go block by block.
BLOCK = 1024
#: Conversations whose ids are joined to one piece of text: those with equal id div PIECE.
PIECE = 4096
ROOT = hashlib.sha256(b"").digest()


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, sha, chars): a conversation's turns by number (null first; equal numbers by digest), from 1 on.

    Positions are counted within blocks of turn numbers and shifted by the blocks before, so a
    conversation that holds a large part of all rows is sorted in many tasks.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    # The role's length stands before it, so that no two pairs of role and text read alike.
    sha = F.unhex(F.sha2(F.concat(F.octet_length(part(role)).cast("string").cast("binary"), F.lit(b":"), part(role), part(text)), 256))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), sha.alias("sha"), F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("chars"))
    turns = common.table(turns.withColumn("block", F.shiftright("turn", 10)), "trie-turns")
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv", "block").agg(F.count("*").alias("n")).select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "sha"))
    at = turns.withColumn("within", within).alias("t").join(blocks.alias("b"), F.col("t.conv").eqNullSafe(F.col("b.conv")) & F.col("t.block").eqNullSafe(F.col("b.block")))
    return at.select("t.conv", (F.col("shift") + F.col("within")).alias("pos"), "sha", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each took the first h turns of its group's first conversation.

    h is crc32 of the decimal id modulo `most`; of the conversation's own turns the first h go. conversations
    has (conv, n); turns has (conv, depth, sha, chars).
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most})
    bases = convs.where(F.col("conv") == F.col("base")).select("base", F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = common.table(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "sha", "chars")
    taken = convs.select("conv", "base", "taken").join(first, "base").where(F.col("depth") <= F.col("taken"))
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sha", "chars")
    return convs.select("conv", "n"), taken.select("conv", "depth", "sha", "chars").unionByName(own)


def _chained(rows: DataFrame) -> DataFrame:
    """(conv, block, depth, digest, parent, chars) of rows (conv, block, depth, chars, sha, seed): each digest of the one before and its sha, a block's first of seed."""

    def run(batches):
        key, digest = None, ROOT
        for batch in batches:
            made, parents = [], []
            for conv, block, sha, seed in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "sha", "seed")), strict=True):
                if (conv, block) != key:
                    key, digest = (conv, block), seed
                parents.append(digest)
                made.append(digest := hashlib.sha256(digest + sha).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "block", "depth", "chars")), pa.array(made, pa.binary()), pa.array(parents, pa.binary())], ["conv", "block", "depth", "chars", "digest", "parent"])

    rows = rows.select(*[F.col(c).cast("long").alias(c) for c in ("conv", "block", "depth", "chars")], "sha", "seed").repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    return rows.mapInArrow(run, "conv long, block long, depth long, chars long, digest binary, parent binary")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, parent, chars) of every prefix with a turn, by chained SHA-256.

    Conversations of over BLOCK turns are cut into blocks: each whole block has a digest of its own, a chain
    of these gives the seed of each block's chain, which is also the digest of the prefix that ends there. Equal
    prefixes have equal digests, as blocks begin at equal depths.
    """
    turns = common.table(turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)), "trie-rebuilt")
    alone = common.table(_chained(turns.withColumn("seed", F.lit(ROOT))), "trie-chains")
    ends = alone.where(F.col("depth") == (F.col("block") + 1) * BLOCK).select("conv", F.lit(0).cast("long").alias("block"), F.col("block").cast("long").alias("depth"), "chars", F.col("digest").alias("sha"))
    seeds = common.table(_chained(ends.withColumn("seed", F.lit(ROOT))).select("conv", (F.col("depth") + 1).alias("block"), F.col("digest").alias("seed")), "trie-seeds")
    later = _chained(turns.where("block > 0").join(seeds, ["conv", "block"]))
    chains = alone.where("block = 0").unionByName(later)
    at_end = F.col("depth") % BLOCK == 0
    closed = chains.where(at_end).withColumn("block", F.col("block") + 1).join(seeds, ["conv", "block"]).drop("digest").withColumnRenamed("seed", "digest")
    return chains.where(~at_end).unionByName(closed).drop("block")


def _path_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """Rows (conv, depth, values) with each value summed from a depth to the conversation's end, block by block."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    within = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*[F.sum(v).alias(v) for v in values])
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"later_{v}") for v in values])
    summed = rows.withColumns({v: F.sum(v).over(within) for v in values})
    return summed.join(blocks, ["conv", "block"]).withColumns({v: F.col(v) + F.col(f"later_{v}") for v in values}).drop("block", *[f"later_{v}" for v in values])


def _ends(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of rows (digest, conv): SHA-256 of a node's ids, ascending, joined by commas.

    Ids are joined by pieces of at most PIECE ids; a task reads a node's pieces in order and holds one batch
    of them, so no list of a node's conversations is ever gathered.
    """
    piece = F.shiftright("conv", PIECE.bit_length() - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("digest", piece.alias("piece")).agg(joined.alias("ids"))

    def run(batches):
        key, sha = None, None
        for batch in batches:
            keys, made = [], []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest != key:
                    if key is not None:
                        keys.append(key)
                        made.append(sha.hexdigest())
                    key, sha = digest, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], ["digest", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    ordered = pieces.select("digest", "piece", "ids").repartition("digest").sortWithinPartitions("digest", "piece")
    return ordered.mapInArrow(run, "digest binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    `convs`: (conv, n), every conversation with its number of turns. `turns`: (conv, depth from 1, sha, chars).
    A node is a distinct prefix, from the root without turns (depth 0) on; its digest chains its turns'.
    A conversation owns the nodes of which it is the smallest member. They are the end of its path, so what
    these nodes give to each of their ancestors is added up along the path before it is exploded over the path's
    prefixes: a row per prefix instead of one per node and ancestor. Grouping by depth and digest then gives
    each subtree's sums. Without conversations there is no node.
    """
    paths = prefixes(turns)
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    paths = common.table(paths.unionByName(roots), "trie-paths")
    nodes = paths.groupBy("depth", "digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"))
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).where(F.col("parent").isNotNull()).withColumnRenamed("parent", "digest")
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = common.table(nodes, "trie-nodes")
    given = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    sums = ["saved_tokens", "n_leaves"]
    along = paths.select("conv", "depth", "digest").join(given, ["conv", "depth"], "left").fillna(0, sums)
    below = _path_sums(along, sums).groupBy("depth", "digest").agg(*[F.sum(v).alias(v) for v in sums]).drop("depth")
    ends = _ends(paths.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("digest", "conv"))
    above = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv_id"))
    made = nodes.join(above, "parent", "left").join(below, "digest").join(ends, "digest", "left")
    return made.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations of `rows`, each with its group's first turns before its own (see `rebuilt`).

    A null role or text counts as empty, a null turn stands first, equal turn numbers are ordered by their
    digests, so repeated rows are turns each; rows without a conversation id belong to none and stay out. Texts
    of any length count whole. Other columns are not read; an empty table gives an empty one. A turn number that
    holds most rows of one conversation is sorted in one task, which spills to disk.
    """
    return trie(*rebuilt(numbered_turns(rows, conv, turn, role, text)))
