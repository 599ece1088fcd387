import numpy as np
import pytest

from cinderbark.llm import boosting
from cinderbark.llm import quality as op
from tests.llm.fixtures import docs, no_docs, words


def test_forest_learns_and_flattened_walk_equals_slow_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = boosting.train(x, y, trees=30, depth=3)
    assert ((f.score(x) > 0.5) == y).mean() > 0.97
    for row, got in zip(x[:50], f.raw(x[:50])):
        total = f.bias
        for t in range(len(f.leaf)):
            at = 0
            while at < f.feature.shape[1]:
                at = 2 * at + 1 + int(row[f.feature[t, at]] > f.cut[t, at])
            total += f.leaf[t, at - f.feature.shape[1]]
        assert got == pytest.approx(total)


def test_forest_without_rows_or_with_one_class():
    assert boosting.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))) == pytest.approx(0.5)
    assert (boosting.train(np.zeros((20, 3)), np.ones(20)).score(np.zeros((2, 3))) > 0.9).all()


def test_held_out_accuracy_and_outputs(spark):
    table = [(i, words(60, i) if i % 3 else " ".join(w.upper() + "!!" for w in words(30, i).split()), "en", "s", 0) for i in range(400)]
    df = spark.createDataFrame(table, docs(spark, clash=False).schema)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(0, 400, 2)] + [(9999, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    out = op.classify(df, labels).collect()
    assert len(out) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.predicted == (r.doc_id % 3 > 0) for r in out if r.held_out)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    kept = op.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id % 3 > 0 for r in kept.collect()} == {True}


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = op.classify(docs(spark), none).collect()
    assert len(out) == docs(spark).count() and {r.score for r in out} == {0.5}
    assert op.classify(no_docs(spark), none).count() == 0
    assert op.keep_good(docs(spark), none).count() == docs(spark).count()
