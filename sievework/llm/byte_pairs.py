"""Byte-level BPE encoding and decoding in padded matrices of pre-tokens of like length."""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.token_counts import SPACE

#: Units of text whose ids a worker remembers.
REMEMBER = 300_000
#: Cells of one matrix.
CELLS = 1 << 18
#: After letters each of these is a pre-token by itself.
MARKS = frozenset(".,;:!?")
#: Pre-tokens stand in the narrowest matrix that holds them.
WIDTHS = (0, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024)
#: Pre-tokens of more bytes are merged one by one from a heap, as a round for each merge would cost the square of their length.
LONG = WIDTHS[-1]
#: Characters of text (or ids) in one batch that a worker returns.
SLICE = 1 << 20
NONE = np.iinfo(np.int32).max


class PairTable:
    """Hash table with open addressing: (left id, right id) to the id that both make together."""

    def __init__(self, keys: np.ndarray, made: np.ndarray):
        self.shift = np.uint64(64 - (4 * max(len(keys), 1)).bit_length())
        size = 1 << int(64 - self.shift)
        self.mask, self.keys, self.made = size - 1, np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for a slot one stays, the others move on
            placed = self.keys[at[left]] == keys[left]
            self.made[at[left[placed]]] = made[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of pairs, NONE where a pair makes none or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], NONE)
        out[(left < 0) | (right < 0)] = NONE
        open_ = np.nonzero((there != keys) & (there >= 0) & (left >= 0) & (right >= 0))
        while len(open_[0]):
            at[open_] = (at[open_] + 1) & self.mask
            there, wanted = self.keys[at[open_]], keys[open_]
            out[open_] = np.where(there == wanted, self.made[at[open_]], NONE)
            more = (there != wanted) & (there >= 0)
            open_ = tuple(x[more] for x in open_)
        return out


class Vocabulary:
    """Ranks of byte strings: encodes texts and decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # \s is Unicode's white space here, which leaves out U+001C to U+001F.
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pretokens = regex.compile(own).findall
        self.spaces = re.compile(r"\s ").search
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    @cached_property
    def pair(self) -> PairTable:
        """All pairs of tokens that make a token together."""
        made = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        parts = np.array(made, np.int64).reshape(-1, 3)
        return PairTable((parts[:, 0] << 32) | parts[:, 1], parts[:, 2].astype(np.int32))

    def merge_rows(self, symbols: np.ndarray) -> list[bytes]:
        """Ids (int32) of every row of a padded matrix (-1 from a row's end on) once no pair of it makes a token.

        In each round every row merges its leftmost pair of lowest rank. That closes one column in all rows;
        rows that have no pair left go.
        """
        out = [b""] * len(symbols)
        rows, ranks = np.arange(len(symbols)), self.pair(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            if len(ended := np.flatnonzero(low == NONE)):
                last = symbols[ended]
                ids, ends = last[last >= 0].tobytes(), 4 * np.cumsum((last >= 0).sum(1))
                for row, begin, end in zip(rows[ended].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    out[row] = ids[begin:end]
                keep = low != NONE
                rows, symbols, ranks, at, low = rows[keep], symbols[keep], ranks[keep], at[keep], low[keep]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            symbols[line, at] = low
            stays = np.ones(symbols.shape, bool)
            stays[line, at + 1] = False
            symbols = symbols[stays].reshape(len(rows), -1)
            ranks = ranks[stays[:, 1:]].reshape(len(rows), -1)
            if len(left := line[at > 0]):
                ranks[left, at[left] - 1] = self.pair(symbols[left, at[left] - 1], symbols[left, at[left]])
            if len(right := line[at < ranks.shape[1]]):
                ranks[right, at[right]] = self.pair(symbols[right, at[right]], symbols[right, at[right] + 1])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """Ids of one long pre-token: the same merges, each found at the top of a heap of (rank, place)."""
        ids, after = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist(), list(range(1, len(raw) + 1))
        before = list(range(-1, len(raw) - 1))
        tokens, ranks, end = self.tokens, self.ranks, len(raw)

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < end and (rank := ranks.get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(end - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if ids[i] != left or (j := after[i]) >= end or ids[j] != right:
                continue  # a side was merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def merge(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids (int32) of pre-tokens; those that are tokens themselves need no merge."""
        out = [b"" if (rank := self.ranks.get(p)) is None else rank.to_bytes(4, sys.byteorder) for p in pretokens]
        sizes = np.array([0 if done else len(p) for p, done in zip(pretokens, out, strict=True)], np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self.merge_long(pretokens[i])
        for least, width in pairwise(WIDTHS):
            bucket = np.flatnonzero((sizes > least) & (sizes <= width))
            for part in np.split(bucket, range(CELLS // width, len(bucket), CELLS // width)):
                raw = np.frombuffer(b"".join([pretokens[i] for i in part.tolist()]), np.uint8)
                matrix = np.full((len(part), width), -1, np.int32)
                matrix[np.arange(width) < sizes[part][:, None]] = self.byte_ids[raw]
                for i, ids in zip(part.tolist(), self.merge_rows(matrix), strict=True):
                    out[i] = ids
        return out

    def learn(self, units: list[str]) -> None:
        """Remembers the ids of units: a blank and what follows by what follows, others by themselves."""
        # A blank and letters are one pre-token; others are cut, and their parts are often known by themselves.
        mixed = [unit for unit in units if not unit[1:].isalpha() or unit[0] != " "]
        pieces = [[unit[:-1], unit[-1]] if unit[-1] in MARKS and unit[0] == " " and unit[1:-1].isalpha() else self.pretokens(unit) for unit in mixed]
        parts = [p for p in {*units, *chain.from_iterable(pieces)}.difference(mixed) if not self.has(p)]
        parts += [unit for unit, own in zip(mixed, pieces, strict=True) if len(own) == 1]
        found = dict(zip(parts, self.merge([p.encode("utf-8", "surrogatepass") for p in parts]), strict=True))
        self.after_blank.update((p[1:], ids) for p, ids in found.items() if p[0] == " ")
        self.known.update((p, ids) for p, ids in found.items() if p[0] != " ")
        for unit, own in zip(mixed, pieces, strict=True):
            if len(own) > 1:
                ids = b"".join(map(self.ids, own))
                if unit[0] == " ":
                    self.after_blank[unit[1:]] = ids
                else:
                    self.known[unit] = ids

    def has(self, unit: str) -> bool:
        return unit[1:] in self.after_blank if unit[0] == " " else unit in self.known

    def ids(self, unit: str) -> bytes:
        return self.after_blank[unit[1:]] if unit[0] == " " else self.known[unit]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (int32) of texts.

        A text is cut before each blank that follows no white space, as no pre-token reaches across; other
        texts are cut into pre-tokens. Units that a worker doesn't remember are encoded together.
        """
        if len(self.known) + len(self.after_blank) > REMEMBER:
            self.known.clear()
            self.after_blank.clear()
        heads, tails = [], []
        for text in texts:
            if self.spaces(text):
                heads.append(self.pretokens(text))
                tails.append([])
            else:
                first, *rest = text.split(" ")
                heads.append([first] if first else [])
                tails.append(rest)
        new = {unit for unit in chain.from_iterable(heads) if not self.has(unit)}
        new.update(" " + x for x in set(filterfalse(self.after_blank.__contains__, chain.from_iterable(tails))))
        self.learn(list(new))
        return [b"".join([*map(self.ids, head), *map(self.after_blank.__getitem__, tail)]) for head, tail in zip(heads, tails, strict=True)]

    @cached_property
    def held(self) -> np.ndarray:
        """Whether there is a token, by id."""
        return np.array([t is not None for t in self.tokens])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of texts from all their ids, one after another, and how many each has."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.tokens) and self.held[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        ends = np.cumsum(sizes).tolist()
        return [b"".join(map(self.tokens.__getitem__, ids[a:b].tolist())) for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _slices(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of rows of a batch that together have about SLICE characters."""
    begin, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin <= i:
        yield begin, i + 1


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of `docs`; rows never leave their task.

    `path`: a file of ranks, a base64 token and its rank a line. Each match of `pattern` is encoded by itself,
    without special tokens: their strings are ordinary text. A null or empty text has no ids. A text of any
    length is encoded whole, a pre-token of over LONG bytes from a heap. A null key stays null, repeated keys and rows give
    a row each, other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(map(len, texts)):
                found = v.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], ids], ["key", "ids"])

    made = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>")
    return made.select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids (null: none) in a further column; an id that the vocabulary lacks is an error.

    The bytes need not be UTF-8, as a caller may cut ids anywhere. Other columns stay as they are, but for
    one that is named as the result.
    """
    kept = [c for c in encoded.columns if c != decoded]
    names = [f"c{i}" for i in range(len(kept))]
    at = kept.index(ids)
    rows = encoded.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)])

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            texts = batch.column(at)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths.tolist()):
                flat = texts[a:b].flatten()
                if flat.null_count:
                    raise ValueError("an id that the vocabulary doesn't have")
                found = v.decode(flat.to_numpy(), lengths[a:b])
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns], pa.array(found, pa.binary())], [*names, "made"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    made = rows.mapInArrow(run, f"{schema}, made binary")
    return made.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("made").alias(decoded))
