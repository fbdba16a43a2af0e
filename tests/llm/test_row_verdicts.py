"""Stages that drop documents judge each row, whatever its key."""

from edges import EDGES

from sievework.llm import decontaminate, simhash


def texts_of(df):
    return sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in df.collect()), key=str)


def test_keep_one_of_each_group_with_null_and_repeated_keys(spark, docs_of):
    # Null, empty and wordless texts are one group; of rows that share key and text one stays.
    docs = docs_of([*EDGES, (9, "p q r s"), (9, "p q r s"), (None, "u v w"), (3, "x y z"), (3, "k l m n")])
    want = [(1, ""), (3, "a b c d e f"), (3, "k l m n"), (3, "x y z"), (7, "twice the same id"), (7, "word word word word "), (9, "p q r s"), (None, "u v w")]
    kept = simhash.keep_one(docs)
    assert texts_of(kept) == sorted(want, key=str) and kept.dtypes == docs.dtypes
    assert simhash.keep_one(docs_of([])).count() == 0


def test_clean_rows_stay_beside_a_leaking_namesake(spark, docs_of):
    leak = " ".join(f"w{i}" for i in range(12))
    docs = docs_of([*EDGES, (None, leak), (7, leak), (11, leak)])
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert texts_of(kept) == texts_of(docs_of(EDGES)) and kept.dtypes == docs.dtypes
