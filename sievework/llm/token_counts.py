"""Token counts by rank-synchronous merging of ragged symbol arrays (byte-level BPE)."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space by the Unicode property, which leaves out the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of this family of vocabularies.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens whose counts a worker remembers.
REMEMBER = 400_000
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts what is left of pre-tokens after all merges, many pre-tokens at a time."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.base = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        specials = sorted((t["content"] for t in model["added_tokens"] if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(PRETOKEN).findall
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def symbols_left(self, pretokens: list[str]) -> np.ndarray:
        """Number of symbols of each pre-token once no merge applies."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        out = sizes.copy()
        symbols = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        rows = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NEVER)
            same = rows[:-1] == rows[1:]
            rank[:-1][same] = self._ranks(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, starts)
            width = np.diff(np.r_[starts, len(symbols)])
            ended = lowest == NEVER
            out[rows[starts[ended]]] = width[ended]
            if ended.all():
                return out
            low = np.repeat(lowest, width)
            hit = (rank == low) & (low != NEVER)
            # Of hits in a row (as in "aaa") every second one, from the left, is a merge.
            place = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= (place - first) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            keep = ~np.r_[False, hit[:-1]] & (low != NEVER)
            symbols, rows = symbols[keep], rows[keep]
        if len(symbols):
            out[rows] = 1
        return out

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            found = self.split(part)
            try:
                total += sum(map(self.known.__getitem__, found))
            except KeyError:
                if len(self.known) > REMEMBER:
                    self.known.clear()
                new = list(set(found).difference(self.known))
                self.known.update(zip(new, self.symbols_left(new).tolist(), strict=True))
                total += sum(map(self.known.__getitem__, found))
        return total


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of `docs`; rows never leave their task.

    `path`: a byte-level BPE vocabulary file. Special strings inside texts count as one token each.
    A null text counts as an empty one: zero bytes, zero tokens. A null key stays null, repeated keys
    give repeated rows, other columns are not read; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        m = merger(path)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            yield pd.DataFrame({"key": batch["key"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [m.count(t) for t in texts]})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInPandas(run, f"key {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
