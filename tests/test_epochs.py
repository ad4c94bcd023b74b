"""M8 and M9: training by rounds and epochs with the best one kept."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.operators import boosting as B
from leakscan.operators import epochs as E
from leakscan.operators import training as TR


@pytest.fixture(scope="module")
def rows(spark):
    words = ["leak", "token", "pass", "tea", "sun", "road", "blue", "milk"]
    data = []
    for k in range(600):
        label = k % 3 == 0
        own = words[:3] if label else words[3:]
        text = " ".join([own[(k + i * i) % len(own)] for i in range(6)] + [words[(k * 7) % 8]])
        data.append((k, text, int(label) if k % 41 else 1 - int(label)))
    df = spark.createDataFrame(data, "id bigint, text string, label int")
    return TR.stratified_split(df)


def test_epochs_learn_and_keep_the_best(spark, rows):
    model, metrics = E.train_by_epochs(rows, epochs=4, batches=4, num_features=1 << 10)
    assert [m["epoch"] for m in metrics] == [1, 2, 3, 4]
    best = max(m["accuracy"] for m in metrics)
    kept = [m for m in metrics if m["best"]]
    assert len(kept) == 1 and kept[0]["accuracy"] == best and kept[0]["epoch"] == min(m["epoch"] for m in metrics if m["accuracy"] == best)
    assert metrics[-1]["train_loss"] < metrics[0]["train_loss"]
    # the pipeline scores as the passes did
    val = rows.where("is_validation")
    assert TR.accuracy(model.transform(val)).first()["accuracy"] == pytest.approx(best)
    assert best > 0.9


def test_reruns_and_other_partitions_give_equal_weights(spark, rows):
    a, ma = E.train_by_epochs(rows, epochs=2, batches=3, num_features=1 << 9)
    b, mb = E.train_by_epochs(rows.repartition(7), epochs=2, batches=3, num_features=1 << 9)
    assert ma == mb
    assert np.array_equal(a.stages[-1].coefficients.toArray(), b.stages[-1].coefficients.toArray())
    assert a.stages[-1].intercept == b.stages[-1].intercept


def test_gradient_equals_numpy(spark, rows):
    prep = E.features_pipeline(1 << 8).fit(rows)
    t = prep.transform(rows)
    path = E.write_batches(t, "id", 2, 42)
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << 8) + 1)
    got = E.pass_over(path, 0, spark, w, True)
    part = t.where(~F.col("is_validation")).where(F.pmod(F.xxhash64(F.lit(42), F.col("id")), F.lit(2)) == 0).select("label", "features").collect()
    x = np.array([r.features.toArray() for r in part])
    y = np.array([r.label for r in part])
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    g = np.append(x.T @ (p - y), (p - y).sum())
    mine = np.array([got.get(k, 0) for k in range(len(w))]) / E.POINT
    assert got[E.ROWS] == len(y) and np.allclose(mine, g, atol=1e-4)
    assert got[E.HITS] == ((p > 0.5) == (y == 1)).sum()


def test_no_validation_rows_and_empty_texts(spark):
    df = spark.createDataFrame([(k, t, k % 2, False) for k, t in enumerate(["", " ", "a b", "c d"] * 5)],
                               "id bigint, text string, label int, is_validation boolean")
    model, metrics = E.train_by_epochs(df, epochs=2, batches=2, num_features=64)
    assert [m["best"] for m in metrics] == [False, True] and metrics[0]["accuracy"] is None
    assert model.transform(df).count() == 20


def test_best_round_with_patience():
    assert B.best_round([0.5, 0.7, 0.7, 0.6, 0.6], 3) == (2, True)
    assert B.best_round([0.5, 0.7, 0.7, 0.6], 3) == (2, False)
    assert B.best_round([0.5, 0.4, 0.4, 0.9], 2) == (1, True)
    assert B.best_round([0.5], 50) == (1, False)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    data = []
    for k in range(400):
        s = float(rng.random())
        data.append((k, s, int(rng.integers(1, 500)), int(rng.integers(1, 90)), int((s > 0.6) != (rng.random() < 0.15)), k % 6 == 0))
    return spark.createDataFrame(data, "id bigint, model_score double, text_length int, word_count int, label int, is_validation boolean")


def test_boosting_is_cut_at_the_best_round(spark, features):
    model, accuracies = B.train_with_patience(features, max_iter=12, max_depth=3, patience=4)
    best, _ = B.best_round(accuracies, 4)
    gbt = model.stages[-1]
    assert len(gbt.trees) == best <= len(accuracies)
    val = features.where("is_validation")
    assert TR.accuracy(model.transform(val)).first()["accuracy"] == pytest.approx(accuracies[best - 1])
    assert accuracies[best - 1] == max(accuracies[:best + 4])


def test_accuracy_of_every_round_equals_shorter_models(spark, features):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    t = VectorAssembler(inputCols=B.FEATURES, outputCol="features").transform(features).select("label", "features", "is_validation")
    fit, val = t.where("NOT is_validation"), t.where("is_validation")
    long = GBTClassifier(labelCol="label", maxIter=6, maxDepth=3, seed=42, stepSize=0.3).fit(fit)
    got = B.accuracy_by_round(long, val)
    for k in (1, 3, 6):
        short = GBTClassifier(labelCol="label", maxIter=k, maxDepth=3, seed=42, stepSize=0.3).fit(fit)
        assert got[k - 1] == pytest.approx(TR.accuracy(short.transform(val)).first()["accuracy"])
        cut = B.first_trees(long, k)
        assert cut.transform(val).select("prediction").collect() == short.transform(val).select("prediction").collect()


def test_features_are_made_in_a_stated_number_of_partitions(spark, rows, monkeypatch):
    """Adaptive execution would leave the tokens of a small compressed shuffle to a few tasks."""
    seen = []
    write = E.write_batches
    monkeypatch.setattr(E, "write_batches", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or write(df, *a))
    one, metrics = E.train_by_epochs(rows.coalesce(1), epochs=1, batches=2, num_features=1 << 6)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert len(metrics) == 1 and one.stages
