"""Searches by slices hold one slice's broadcast at a time."""

import numpy as np
import pytest

from tastegraph.llm import ann, decontam


@pytest.fixture
def sent(spark, monkeypatch):
    """Broadcasts in the order they were made; with each, how many of the earlier ones were still held."""
    made, held = [], []
    plain = spark.sparkContext.broadcast

    def broadcast(value):
        held.append(sum(b._jbroadcast.isValid() for b in made))
        made.append(plain(value))
        return made[-1]

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    return made, held


def test_nearest_holds_one_slice(spark, monkeypatch, sent):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 200)
    found = ann.nearest(df)
    made, held = sent
    assert len(made) == 3 and held == [0, 0, 0] and not any(b._jbroadcast.isValid() for b in made)
    assert found.count() == 40


def test_decontamination_holds_one_slice(spark, sent):
    text = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)]
    docs = spark.createDataFrame([(k, "some words before " + t + " and after") for k, t in enumerate(text)], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(list(enumerate(text)), "item_id long, text string"), slice_chars=300)
    made, held = sent
    assert len(made) > 2 and set(held) == {0} and not any(b._jbroadcast.isValid() for b in made)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, k) for k in range(8)}
