"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols: 0 for what is no letter, 1 to 26 for a to z, the rest shared by all other letters.
SYMBOLS = 64
DIMENSIONS = 1024
UNKNOWN = "und"
#: Trigrams whose vectors a worker makes at a time, characters and texts that it bundles at a time, rows that it returns at a time.
BLOCK, CHARS, TEXTS, ROWS = 4_096, 500_000, 256, 512
#: Trigrams of labelled texts that a task holds before it counts them.
COUNTED = 4_000_000


@lru_cache(maxsize=1)
def _symbol_of() -> np.ndarray:
    codes = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out = np.where(letter, 27 + codes * 2654435761 % (1 << 32) % (SYMBOLS - 27), 0).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def grams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of a text; what is no letter counts as one gap. No letter: none."""
    if not text:
        return np.empty(0, np.int32)
    seen = _symbol_of()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    s = np.concatenate((np.zeros(1, np.uint8), seen, np.zeros(1, np.uint8)))
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    if len(s) < 3:
        return np.empty(0, np.int32)
    s = s.astype(np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


@lru_cache(maxsize=4)
def _letters(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """The bound vector of each trigram: the product of its letters' vectors, each rotated by its place."""
    two, one, none = _letters(dimensions, seed)
    return (two[codes // SYMBOLS**2] * one[codes // SYMBOLS % SYMBOLS] * none[codes % SYMBOLS]).astype(np.float32)


def bundle(found: list[np.ndarray], dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """The sum of each text's trigram vectors, one row per text; only BLOCK trigrams' vectors exist at a time."""
    out = np.zeros((len(found), dimensions), np.float32)
    per_text = [np.unique(x, return_counts=True) for x in found]
    code = np.concatenate([c for c, _ in per_text]) if per_text else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(found)), [len(c) for c, _ in per_text])
    times = np.concatenate([n for _, n in per_text]) if per_text else np.empty(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, row, times = code[order], row[order], times[order]
    different, first = np.unique(code, return_index=True)
    for at in range(0, len(different), BLOCK):
        part = different[at : at + BLOCK]
        inside = slice(first[at], first[at + BLOCK] if at + BLOCK < len(different) else len(code))
        counts = np.zeros((len(found), len(part)), np.float32)
        counts[row[inside], np.searchsorted(part, code[inside])] = times[inside]
        out += counts @ gram_vectors(part, dimensions, seed)
    return out


def learn(examples: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """(labels, unit prototypes) from all rows of `examples` with a label.

    Bundling is a sum, so a prototype is its language's trigram counts times their vectors: tasks count up to COUNTED
    trigrams at a time, one aggregation adds, and a task bundles one label, of at most SYMBOLS ** 3 counts. The
    driver gets the prototypes alone, `dimensions` numbers a label, and so does every worker that predicts.
    """

    def counted(held: dict[str, list[np.ndarray]]):
        for label, codes in held.items():
            at, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"lang": label, "gram": at.astype(np.int64), "n": n})

    def run(batches):
        held, size = {}, 0
        for b in batches:
            for label, value in zip(b["lang"], b["text"], strict=True):
                if len(g := grams(value)):
                    held.setdefault(label, []).append(g)
                    size += len(g)
                if size > COUNTED:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def bundled(own: pd.DataFrame) -> pd.DataFrame:
        own, out = own.sort_values("gram"), np.zeros(dimensions)
        for at in range(0, len(own), BLOCK):
            part = own.iloc[at : at + BLOCK]
            out += part["n"].to_numpy(np.float64) @ gram_vectors(part["gram"].to_numpy(np.int64), dimensions, seed)
        return pd.DataFrame({"lang": own["lang"].iloc[:1], "v": [(out / max(np.linalg.norm(out), 1e-12)).tolist()]})

    rows = examples.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    made = counts.groupBy("lang").applyInPandas(bundled, "lang string, v array<double>").toPandas().sort_values("lang")
    return made["lang"].tolist(), np.array(made["v"].tolist(), np.float64).reshape(-1, dimensions)


def _scores(found: list[np.ndarray], prototypes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Cosines of texts with prototypes, a row per text."""
    v = bundle(found, dimensions, seed)
    return (v @ prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _told(docs: DataFrame, text: str, labels: list[str], prototypes: np.ndarray, dimensions: int, seed: int) -> DataFrame:
    """`docs` with its columns named c0, c1, ... and after them lang_pred and score.

    Every column goes to Python once, as Arrow, and back untouched; only texts become objects there, a
    few hundred at a time.
    """
    share, at = prototypes.astype(np.float32), docs.columns.index(text)

    def verdicts(texts):
        near, hold, chars = [], [], 0
        for value in texts:
            hold.append(grams(value.as_py()))
            chars += len(hold[-1])
            if len(hold) == TEXTS or chars > CHARS:
                near.append(_scores(hold, share, dimensions, seed))
                hold, chars = [], 0
        near = np.concatenate([*near, _scores(hold, share, dimensions, seed)])
        letters = np.abs(near).sum(axis=1) > 0
        best = np.array(labels, object)[near.argmax(axis=1)] if labels and len(near) else np.full(len(near), UNKNOWN, object)
        top = near.max(axis=1).clip(0, 1) if labels and len(near) else np.zeros(len(near))
        return np.where(letters, best, UNKNOWN), np.where(letters, top, 0).astype(float)

    def run(batches):
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, max(whole.num_rows, 1), ROWS)):
            pred, score = verdicts(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return rows.mapInArrow(run, schema + ", lang_pred string, score double")


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """(key, lang_pred, score) of every row of `docs`, from its whole text alone.

    score is the cosine with the nearest prototype, 0 where that is negative. A text that is null,
    empty or without a letter is `und` with score 0, as is every text where nothing was learned. Of
    equal cosines the first label in alphabetical order wins. Null and repeated keys stay as they are,
    repeated rows give repeated rows, other columns are not read, an empty table gives an empty one.
    Very long texts are counted whole; only their trigrams' counts meet the vectors.
    """
    made = _told(docs.select(key, text), text, labels, prototypes, dimensions, seed)
    return made.select(F.col("c0").alias(key), "lang_pred", "score")


def keep_told(docs: DataFrame, labels: list[str], prototypes: np.ndarray, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """The rows of `docs` whose language can be told, with an absent `lang` (null or empty) filled in.

    Rejected are null texts and texts without a letter, nothing else: where no language was learned all
    texts with a letter stay, and their `lang` as it is. Null keys, repeated rows and columns of any name
    (lang_pred and score too) stay as they are; an empty table gives an empty one.
    """
    if not labels:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    made = _told(docs, text, labels, prototypes, dimensions, seed).where(F.col("lang_pred") != UNKNOWN)
    given = f"c{docs.columns.index(lang)}"
    filled = F.coalesce(F.nullif(F.col(given), F.lit("")), "lang_pred")
    return made.select(*[(filled if c == lang else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
