"""Rows that every operator must handle: nulls, no words, ties, repeated keys, a long text."""

EDGES = [(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (5, "\n \n"), (None, "x y z"), (7, "word " * 30_000), (7, "twice the same id")]
