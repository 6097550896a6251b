"""Rows that share a doc_id, or have none, are kept and dropped each for its own text."""

from tastegraph.llm import decontam, simhash

SCHEMA = "doc_id long, text string"
A, B, C = (" ".join(f"{p}{k}" for k in range(60)) for p in "abc")


def test_keep_first_tells_rows_of_one_id_apart(spark):
    rows = [(None, A), (None, B), (None, B), (7, A), (7, C), (8, C), (9, "x y"), (9, "x y")]
    got = simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, B), (7, A), (7, C), (9, "x y")], key=str)
    # An id that stands for two groups keeps the row of its own group alone.
    rows = [(1, A), (2, A), (2, B), (3, B)]
    got = simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, A), (2, B)]


def test_drop_contaminated_tells_rows_of_one_id_apart(spark):
    rows = [(None, f"before {A} after"), (None, B), (5, A), (5, C), (6, B), (7, None), (7, "")]
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = decontam.drop_contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(None, B), (5, C), (6, B), (7, None), (7, "")], key=str)
