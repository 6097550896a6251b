import pytest

from tastegraph.sources import textmodels as T

MODEL = [(5, 1, 9, 0.5), (5, 2, 7, 0.25), (7, 1, 5, 0.125), (9, 1, 5, 1e-17), (9, 2, 7, 0.1)]
SCHEMA = "item_id long, rk int, similar_id long, score double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_item_model(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in MODEL], SCHEMA + ", value string")  # the extra column takes no part
    for label in (None, "any"):
        path = f"file://{tmp_path}/m-{label}"
        T.write_item_model(df, path, label)
        assert rows(T.read_item_model(spark, path)) == MODEL
    words = text_of(tmp_path / "m-any").split()
    assert words[:4] == ["any-1", "2", "6", "3"] and words[4:13] == ["5", "7", "9", "9", "7", "5", "0", "5", "7"]


def test_file_split_among_tasks(spark, tmp_path):
    """A file that is cut into many splits has the same values in the same places."""
    n = 3000
    text = f"  2 {2 * n}\n{n}\n\n" + "\n".join([*(f"{k:10d}" for k in range(1, n + 1)), *(f"{k}" for k in range(1, 2 * n + 1)), *(f" {k / 4:.12e}" for k in range(2 * n))]) + "\n"
    path = write(tmp_path, "long", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = T.read_item_model(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == [(k // 2 + 1, k % 2 + 1, k + 1, k / 4) for k in range(2 * n)]


def test_versions_and_broken_files(spark, tmp_path):
    body = "1\n1\n1\n4\n6\n0.5\n"
    for head in ("", "any-1\n"):
        assert rows(T.read_item_model(spark, write(tmp_path, f"v{len(head)}", head + body))) == [(4, 1, 6, 0.5)]
    newer = write(tmp_path, "v2", "any-2\n" + body)
    with pytest.raises(ValueError, match="newer"):
        T.read_item_model(spark, newer)
    assert T.read_item_model(spark, newer, newest=2).count() == 1
    for cut in ("", "1\n1\n", "1\n1\n1\n4\n6\n"):
        with pytest.raises(ValueError, match="ends"):
            T.read_item_model(spark, write(tmp_path, f"cut{len(cut)}", cut))


def test_factors(spark, tmp_path):
    want = [(3, [0.1, -2.5, 3e-9]), (8, [4.0, 5.0, 6.0]), (200_000, [7.0, 8.0, 0.0])]
    path = f"file://{tmp_path}/items"
    T.write_item_factors(spark.createDataFrame(want, "item_id long, factors array<double>"), 0.1, path)
    assert text_of(tmp_path / "items").split()[:8] == ["0.1", "3", "3", "3", "3", "8", "200000", "0.1"]
    penalty, got = T.read_item_factors(spark, path)
    assert penalty == 0.1 and sorted((r[0], list(r[1])) for r in got.collect()) == want
    path = f"file://{tmp_path}/users"
    T.write_user_factors(spark.createDataFrame(want, "user_id long, factors array<double>"), path, "any")
    assert text_of(tmp_path / "users").split()[:8] == ["any-1", "3", "9", "3", "3", "8", "200000", "0.1"]
    assert sorted((r[0], list(r[1])) for r in T.read_user_factors(spark, path).collect()) == want


def test_empty_models_and_samples(spark, tmp_path):
    path = f"file://{tmp_path}"
    T.write_item_model(spark.createDataFrame([], SCHEMA), f"{path}/none")
    assert T.read_item_model(spark, f"{path}/none").count() == 0
    T.write_user_factors(spark.createDataFrame([], "user_id long, factors array<double>"), f"{path}/nobody")
    assert T.read_user_factors(spark, f"{path}/nobody").count() == 0
    sample = spark.createDataFrame([(9 - k, k + 1) for k in range(9)], "user_id long, ord long")
    for label in (None, "any"):
        T.write_sample(sample, f"{path}/s-{label}", label)
        assert rows(T.read_sample(spark, f"{path}/s-{label}", 3)) == [(7, 3), (8, 2), (9, 1)]
    T.write_sample(sample.limit(0), f"{path}/s0")
    assert T.read_sample(spark, f"{path}/s0", 3).count() == 0


def test_zero_as_an_identifier(spark, tmp_path):
    rows_ = [(0, 1, 4, 0.5), (4, 1, 0, 0.5), (4, 2, 8, 0.25)]
    df, path = spark.createDataFrame(rows_, SCHEMA), f"file://{tmp_path}/zero"
    with pytest.raises(ValueError, match="unused"):
        T.write_item_model(df, path)
    T.write_item_model(df, path, unused=-1)
    assert rows(T.read_item_model(spark, path, unused=-1)) == rows_
    with pytest.raises(ValueError, match="unused"):
        T.write_user_factors(spark.createDataFrame([(0, [1.0])], "user_id long, factors array<double>"), path)
