"""Consistent sharding through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime number of slots; shares differ by about shards / SLOTS.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, salt: str, below: int) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big") % below


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in `shards`) of every slot.

    Each shard prefers slots in an order of its own (offset, then steps of its skip, modulo the prime
    number of slots, so all of them in the end); shards take turns, each claiming its best free slot,
    until none is free. So shares differ by one slot at most, and adding or removing a shard moves
    little besides that shard's own part. Names decide, not their order; they must differ.
    """
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("needs a prime number of slots, and as many different shards at most")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = [_draw(s, "offset", slots) for s in shards]
    skip = [_draw(s, "skip", slots - 1) + 1 if slots > 2 else 1 for s in shards]
    tried = [0] * len(shards)
    table = np.full(slots, -1, np.int64)
    left = slots
    while left:
        for i in turns:
            slot = (offset[i] + tried[i] * skip[i]) % slots
            while table[slot] >= 0:
                tried[i] += 1
                slot = (offset[i] + tried[i] * skip[i]) % slots
            table[slot] = i
            tried[i] += 1
            left -= 1
            if not left:
                break
    return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column: 60 bits of its MD5, modulo the slots; a null key counts as an empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`rows` with slot and shard. The table has `slots` rows whatever the input, so it is broadcast.

    Rows stay in their tasks: one hash and one lookup each. Equal keys share a shard; null keys share
    the empty string's; an empty table gives an empty one. Columns of `rows` named slot or shard give way
    to the operator's own, unless one is the key. Texts are not read, however long.
    """
    if key in ("slot", "shard"):
        raise ValueError(f"the key cannot be named {key}")
    rows = rows.drop("slot", "shard")
    table = lookup_table(shards, slots)
    named = rows.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")
    return rows.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(named), "slot").select(*rows.columns, "slot", "shard")
