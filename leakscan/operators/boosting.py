"""Boosted trees with patience (M8): the validation accuracy of every round decides.

Boosting is deterministic for a seed, so the trees of a longer run begin with those of a
shorter one. Rounds are trained in growing runs; after each run one pass per block of trees over the
validation rows gives the accuracy after every single round. Training ends when ``patience`` rounds
brought no better accuracy (or all rounds are used); the model is cut behind its best round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

FEATURES = ["model_score", "text_length", "word_count"]
BLOCK = 50


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"boosting-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def accuracy_by_round(model, rows: DataFrame) -> list[float]:
    """Share of right predictions on ``rows`` (label, features) after each round."""
    trees, weights = model.trees, model.treeWeights
    n = rows.count()
    if not n:
        return []
    out: list[float] = []
    at = rows.select("label", "features", F.lit(0.0).alias("margin"))
    for lo in range(0, len(trees), BLOCK):
        part = range(lo, min(len(trees), lo + BLOCK))
        df = at
        for k in part:
            df = trees[k].setFeaturesCol("features").setPredictionCol(f"t{k}").transform(df)
        steps = df.select("label", "features", "margin", F.array(*[F.col(f"t{k}") * F.lit(weights[k]) for k in part]).alias("s"))
        margins = F.transform(F.col("s"), lambda _, i: F.aggregate(F.slice("s", 1, i + 1), F.col("margin"), lambda a, x: a + x))
        at = _written(steps.select("label", "features", margins.alias("ms"), F.element_at(margins, -1).alias("margin")), "margins")
        right = [F.sum(((F.col("ms")[k] > 0) == (F.col("label") == 1)).cast("long")) for k in range(len(part))]
        out += [r / n for r in at.agg(*[c.alias(f"r{k}") for k, c in enumerate(right)]).first()]
    return out


def best_round(accuracies: list[float], patience: int) -> tuple[int, bool]:
    """(best round counted from 1, whether patience ended the run): the earliest round of the best
    accuracy that was met before ``patience`` rounds went without a better one."""
    best = 0
    for k, a in enumerate(accuracies):
        if a > accuracies[best]:
            best = k
        if k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model, k: int):
    """The model after its first ``k`` rounds."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession
    sc = SparkSession.active().sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    weights = gateway.new_array(gateway.jvm.double, k)
    own = model._java_obj.trees()
    for i in range(k):
        trees[i] = own[i]
        weights[i] = float(model.treeWeights[i])
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"gbt_{uuid.uuid4().hex[:12]}", trees, weights, model.numFeatures, 2)
    return GBTClassificationModel(java)


def train_with_patience(features: DataFrame, max_iter: int = 500, step_size: float = 0.05, max_depth: int = 6,
                        seed: int = 42, patience: int = 50):
    """M8: ``features`` (``FEATURES``, label, is_validation) -> (fitted pipeline cut at the best round,
    accuracy of every trained round). Without validation rows all rounds are kept."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = _written(asm.transform(features).select("label", "features", "is_validation"), "rows")
    fit, val = rows.where(~F.col("is_validation")), rows.where("is_validation")
    rounds = min(max_iter, patience + patience // 2 + 1)
    while True:
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, stepSize=step_size,
                              maxDepth=max_depth, seed=seed).fit(fit)
        accuracies = accuracy_by_round(model, val)
        if not accuracies:
            if rounds == max_iter:
                return PipelineModel(stages=[asm, model]), []
            rounds = max_iter
            continue
        best, done = best_round(accuracies, patience)
        if done or rounds == max_iter:
            return PipelineModel(stages=[asm, first_trees(model, best)]), accuracies
        rounds = min(max_iter, 2 * rounds)
