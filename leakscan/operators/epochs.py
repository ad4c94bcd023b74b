"""Training of the text classifier by epochs (M9).

Tokens of the whole text become normalised, hashed TF-IDF features; they are written
once, in mini-batches dealt by a hash of the key. A step reads one mini-batch (a folder of
its own), sums its gradient in the tasks and then by feature, and updates the weights; an epoch
goes once over all mini-batches. After each epoch the validation rows are scored; the weights of the
best epoch are kept (the earliest of equal ones).

Gradients and losses are summed as integers (fixed point), so neither the order of
rows nor the cut of tasks changes a weight, and reruns are equal. The driver holds the weights and one
gradient: ``num_features`` numbers, whatever the number of rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

POINT = 1 << 24          # fixed point of gradients; features and errors are at most 1 in size
VALIDATION = -1          # number of the validation "batch"
ROWS, LOSS, HITS = -1, -2, -3   # slots of the counts that travel with a gradient


def features_pipeline(num_features: int):
    """tokens -> hashed TF -> IDF -> unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, SQLTransformer
    tok = SQLTransformer(statement=(
        "SELECT *, regexp_extract_all(lower(text), '(?U)[^\\\\s\\\\x1c-\\\\x1f]+', 0) AS tokens FROM __THIS__"))
    return Pipeline(stages=[tok, HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
                            IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")])


def write_batches(rows: DataFrame, key: str, batches: int, seed: int) -> str:
    """``rows`` (label, features, is_validation, key) as one folder a mini-batch."""
    number = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(batches)).cast("int")
    out = rows.select(F.col("label").cast("double").alias("label"), "features",
                      F.when(F.col("is_validation"), F.lit(VALIDATION)).otherwise(number).alias("batch"))
    path = scratch_path(rows.sparkSession, f"epochs-{uuid.uuid4().hex}")
    # files by the size of a batch, not one for each task that made features
    out.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    return path


def _rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per row, feature numbers, values) of an Arrow column of sparse vectors."""
    col = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    idx, val = col.field("indices"), col.field("values")
    if idx.null_count:
        raise ValueError("sparse vectors are expected")
    return (idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
            idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), val.flatten().to_numpy(zero_copy_only=False))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; each depends on its own values only."""
    if not len(counts):
        return np.zeros(0)
    starts = np.cumsum(counts) - counts
    return np.where(counts > 0, np.add.reduceat(np.append(values, 0.0), starts), 0.0)


def pass_over(path: str, number: int, spark, weights: np.ndarray, gradient: bool) -> dict[int, int]:
    """One mini-batch at these weights (the last one is the intercept): slot -> fixed-point sum of
    the gradient, rows, loss and right predictions."""
    import pyarrow as pa
    shared = spark.sparkContext.broadcast(weights)
    bias = len(weights) - 1

    def run(batches):
        w = shared.value
        total = np.zeros(len(w), np.int64)
        rows = loss = hits = 0
        for b in batches:
            n, idx, val = _rows(b.column("features"))
            y = b.column("label").to_numpy(zero_copy_only=False)
            margin = _sums(w[idx] * val, n) + w[bias]
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))
            rows += len(y)
            hits += int(((p > 0.5) == (y == 1.0)).sum())
            loss += int(np.rint(POINT * np.logaddexp(0.0, np.where(y == 1.0, -margin, margin))).sum())
            if gradient:
                err = p - y
                # whole numbers below 2^53: the sums of a batch are exact in any order
                total[:bias] += np.bincount(idx, np.rint(POINT * np.repeat(err, n) * val), bias).astype(np.int64)
                total[bias] += int(np.rint(POINT * err).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [ROWS, LOSS, HITS]]).astype(np.int32)),
             pa.array(np.concatenate([total[at], [rows, loss, hits]]).astype(np.int64))], names=["slot", "g"])

    table = spark.read.parquet(path).where(F.col("batch") == number).select("label", "features")
    got = table.mapInArrow(run, "slot int, g bigint").groupBy("slot").agg(F.sum("g").alias("g")).toPandas()
    shared.unpersist()
    return dict(zip(got["slot"].tolist(), got["g"].tolist()))


class Adam:
    """Adam with decoupled weight decay and a rate that falls linearly to zero."""

    def __init__(self, size: int, rate: float, decay: float, steps: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.decay, self.steps = rate, decay, steps

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate = self.rate * (1 - self.t / self.steps)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9 ** self.t), self.v / (1 - 0.999 ** self.t)
        kept = w * (1 - rate * self.decay)
        kept[-1] = w[-1]
        return kept - rate * m / (np.sqrt(v) + 1e-8)


def logistic_model(spark, weights: np.ndarray):
    """A fitted Spark ML model of these weights, which scores inside the JVM and is saved with its pipeline."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import DenseVector
    vector = _py2java(spark.sparkContext, DenseVector(weights[:-1]))
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"epochs_{uuid.uuid4().hex[:12]}", vector, float(weights[-1]))
    return LogisticRegressionModel(java)


def train_by_epochs(rows: DataFrame, key: str = "id", epochs: int = 4, batches: int = 8, num_features: int = 1 << 18,
                    rate: float = 0.1, decay: float = 0.01, seed: int = 42):
    """M9: ``rows`` (key, text, label 0/1, is_validation) -> (fitted pipeline of the best epoch, metrics).
    ``metrics``: one dict an epoch with epoch, train_loss, accuracy (of the validation rows; None without
    any, then the last epoch counts) and best."""
    from pyspark.ml import PipelineModel
    spark = rows.sparkSession
    ship_package(spark)
    # a stated number of partitions: by the bytes of compressed text that it reads, adaptive execution would
    # leave the two passes over all tokens to a few tasks
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    prep = features_pipeline(num_features).fit(rows.where(~F.col("is_validation")))
    path = write_batches(prep.transform(rows), key, batches, seed)
    w = np.zeros(num_features + 1)
    adam = Adam(len(w), rate, decay, epochs * batches)
    metrics, best = [], None
    for epoch in range(1, epochs + 1):
        loss = n = 0
        for number in range(batches):
            got = pass_over(path, number, spark, w, True)
            count = got.pop(ROWS, 0)
            if not count:
                continue
            loss, n = loss + got.pop(LOSS), n + count
            got.pop(HITS)
            g = np.zeros(len(w))
            g[np.fromiter(got, np.int64, len(got))] = np.fromiter(got.values(), np.float64, len(got)) / (POINT * count)
            w = adam.step(w, g)
        seen = pass_over(path, VALIDATION, spark, w, False)
        accuracy = seen[HITS] / seen[ROWS] if seen.get(ROWS) else None
        metrics.append({"epoch": epoch, "train_loss": loss / (POINT * n) if n else None, "accuracy": accuracy})
        if best is None or accuracy is None or accuracy > best[0]:
            best = (accuracy, epoch, w)
    for m in metrics:
        m["best"] = m["epoch"] == best[1]
    return PipelineModel(stages=[*prep.stages, logistic_model(spark, best[2])]), metrics
