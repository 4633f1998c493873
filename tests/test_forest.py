"""Forests: both ways of growing give the same trees, splits are the best by Gini, leaves are pure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest as R
from tessera.operators.boosting import binned
from tessera.operators.models import TrainedModel, fit_classifier
from tests.test_boosting import blobs, frame


def test_best_cut_against_gini():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = rng.integers(0, 3, (9, 3)) * rng.choice([0.5, 1, 2], (9, 1))
        gini = lambda c: c.sum() - (c.sum(0) ** 2).sum() / c.sum() if c.sum() else 0.0
        every = [(gini(counts[: k + 1]) + gini(counts[k + 1 :]), k) for k in range(8) if counts[: k + 1].sum() and counts[k + 1 :].sum()]
        found = R.best_cut(counts)
        assert (found is None) == (not every)
        if found:
            assert gini(counts[: found[1] + 1]) + gini(counts[found[1] + 1 :]) == pytest.approx(min(every)[0])


def test_rows_are_drawn_as_often_as_poisson_says():
    drawn = np.concatenate([R.times_drawn(np.arange(5000), t, 7) for t in range(8)])
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01 and abs(drawn.var() - 1) < 0.05
    a, b = R.times_drawn(np.arange(5000), 0, 7), R.times_drawn(np.arange(5000), 1, 7)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.05 and (a == R.times_drawn(np.arange(5000), 0, 7)).all()


def test_upper_levels_over_the_cluster_give_the_same_trees(spark):
    x, y, weight = blobs(n=400)
    rows = frame(spark, x, y, weight).coalesce(1)
    whole = R.fit_forest(rows, 3, seed=5, trees=3)
    for local in (6 * 100, 6 * 30):
        parts = R.fit_forest(rows, 3, seed=5, trees=3, local=local)
        assert [sorted(t.feature.tolist()) for t in parts.trees] == [sorted(t.feature.tolist()) for t in whole.trees]
        assert np.allclose(parts.proba(x), whole.proba(x))
    bins = binned(x, whole.edges)
    for t, tree in enumerate(whole.trees):  # every row of a tree is in a leaf of its class alone: no depth stops it
        drawn = R.times_drawn(np.arange(400), t, 5) > 0
        assert (tree.shares[tree.leaf_of(bins[drawn])].argmax(1) == y[drawn]).mean() > 0.99
        assert (tree.feature < 0).sum() > 10


def test_rf_classifier(spark, tmp_path, monkeypatch):
    import tessera.operators.models as models

    old = models.fit_forest
    monkeypatch.setattr(models, "fit_forest", lambda r, k, seed: old(r, k, seed, trees=40))
    x, y, weight = blobs(n=700, seed=4)
    rows = frame(spark, x, y, weight).withColumn("label", F.expr("concat('c', y)")).drop("weight", "y")
    model = fit_classifier("rf", rows.limit(500), 1, "balanced")
    model.save(tmp_path / "m")
    again = TrainedModel.load(tmp_path / "m")
    test = frame(spark, x[500:], y[500:], weight[500:])
    a, b = (np.array([r["proba"] for r in m.probabilities(test).orderBy("features").select("proba").collect()]) for m in (model, again))
    truth = np.array([r["y"] for r in test.orderBy("features").select("y").collect()])
    assert np.allclose(a, b) and np.allclose(a.sum(1), 1)
    # no worse than Spark's forest of the same number of trees, whose depth is limited
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    vectors = lambda f: f.withColumn("v", array_to_vector("features"))
    spark_own = RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="weight", numTrees=40, maxDepth=30, seed=1).fit(vectors(frame(spark, x[:500], y[:500], np.ones(500))))
    theirs = np.array([r["prediction"] for r in spark_own.transform(vectors(test)).orderBy("features").select("prediction").collect()])
    assert (a.argmax(1) == truth).mean() >= (theirs == truth).mean() - 0.02


def test_constant_features_and_nothing(spark):
    schema = "y int, weight double, features array<double>"
    same = R.fit_forest(spark.createDataFrame([(k % 2, 1.0, [3.0, 4.0]) for k in range(40)], schema), 2, trees=3)
    assert all(len(t.feature) == 1 for t in same.trees) and same.proba(np.array([[3.0, 4.0]])).sum() == pytest.approx(1)
    large = R.fit_forest(spark.createDataFrame([(k % 2, 1.0, [3.0, 4.0]) for k in range(40)], schema), 2, trees=3, local=4)
    assert np.allclose(large.proba(np.array([[3.0, 4.0]])), same.proba(np.array([[3.0, 4.0]])))
    assert R.fit_forest(spark.createDataFrame([], schema), 2).trees == []
