"""Licence scans: each template's rare words look up its places, key phrases confirm them."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases that name a licence wherever they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages by which the method knows a licence, each with its label and the phrases that must stand at their place.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("cc", "this work is licensed under a creative commons attribution license", ("creative commons",)),
)
#: Share of a template's words that must stand in place.
COVERAGE = 0.6


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Index:
    """Template words and their places."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].encode().split() for t in templates]
        self.phrases = [[p.encode().split() for p in t[2]] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for place, w in enumerate(words):
                self.postings[w].append((t, place))
        self.postings = dict(self.postings)
        self.places = [Counter(words) for words in self.words]

    def lookups(self, t: int, where: dict[bytes, list[int]], idf: dict[bytes, float]) -> list[bytes]:
        """Template t's rarest words that a file holds, so many that no place with COVERAGE lacks them all.

        If none of some words stood in its place, their places would be missing from the coverage: so
        those words do that have more places than may be missing. Words that the file does not hold are
        missing anyway; if they alone are too many, the file cannot have the template.
        """
        spare = len(self.words[t]) - COVERAGE * len(self.words[t]) + 1e-9
        spare -= sum(n for w, n in self.places[t].items() if w not in where)
        out: list[bytes] = []
        if spare < 0:
            return out
        for w in sorted((w for w in self.places[t] if w in where), key=lambda w: (-idf.get(w, 0.0), w)):
            out.append(w)
            spare -= self.places[t][w]
            if spare < 0:
                break
        return out

    def scan(self, words: list[bytes], where: dict[bytes, list[int]], idf: dict[bytes, float]) -> dict[str, float]:
        """{label: coverage} of the templates that a file holds."""
        spots = {(t, at - place) for t in range(len(self.words)) for w in self.lookups(t, where, idf) for of, place in self.postings[w] if of == t for at in where[w]}
        found: dict[str, float] = {}
        for t, shift in spots:
            template = self.words[t]
            hits = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(template))
            share = hits / len(template)
            if share < COVERAGE or found.get(self.labels[t], 0) >= share:
                continue
            if all(self._stands(words, p, shift + _find(template, p)) for p in self.phrases[t]):
                found[self.labels[t]] = share
        return found

    @staticmethod
    def _stands(words: list[bytes], phrase: list[bytes], at: int) -> bool:
        return at >= 0 and words[at : at + len(phrase)] == phrase


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def word_idf(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> dict[bytes, float]:
    """IDF of the template words over all documents; a row per template word at most reaches the driver."""
    wanted = set(vocabulary)

    def run(batches):
        counts, n = Counter(), 0
        for b in batches:
            for value in b["text"]:
                n += 1
                counts.update(wanted.intersection(words_of(value)))
        yield pd.DataFrame({"word": [None, *(w.decode() for w in counts)], "n": [n, *counts.values()]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.pop(None, 0)
    return {w: math.log((1 + total) / (1 + counts.get(w.decode(), 0))) for w in vocabulary}


def base_places(where: dict[bytes, list[int]], words: list[bytes]) -> dict[str, list[int]]:
    """{label: starts} of the base phrases."""
    out: dict[str, list[int]] = defaultdict(list)
    for phrase, label in BASE.items():
        p = phrase.encode().split()
        for at in where.get(p[0], ()):
            if words[at : at + len(p)] == p:
                out[label].append(at)
    return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Licences of every row of `docs`, from its whole text; rows never leave their task.

    Columns: key, n_words, n_base (places of base phrases), first_word and last_word (their smallest
    and largest start, from 0; null without any), base_labels, labels (with those of the templates;
    both sorted and comma-joined, empty without any), score (1 for a base phrase or a template in
    full, else the best template's coverage, 0 without any). A null text counts as empty; null and
    repeated keys stay; an empty table gives an empty one.
    """
    index = Index(templates)
    vocabulary = sorted(set(index.postings) | {w.encode() for p in BASE for w in p.split()})
    idf = word_idf(docs, vocabulary, text)
    kind = docs.schema[key].dataType.simpleString()
    known = set(vocabulary)

    def run(batches):
        for b in batches:
            rows = []
            for k, value in zip(b["key"].astype(object).where(b["key"].notna(), None), b["text"], strict=True):
                words = words_of(value)
                where: dict[bytes, list[int]] = {}
                if not known.isdisjoint(words):
                    for at, w in enumerate(words):
                        if w in known:
                            where.setdefault(w, []).append(at)
                base = base_places(where, words)
                starts = [s for found in base.values() for s in found]
                more = index.scan(words, {w: v for w, v in where.items() if w in index.postings}, idf)
                labels = sorted(set(base) | set(more))
                score = 1.0 if base else max(more.values(), default=0.0)
                rows.append((k, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score))
            out = pd.DataFrame(rows, columns=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "key": object})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInPandas(run, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return made.withColumnRenamed("key", key)
