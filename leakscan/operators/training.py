"""Model score, label cleaning, features and training (M1-M11) on Spark ML.

The reference fine-tunes a transformer and a boosted-tree model on one
machine. Here the same tasks are Spark ML pipelines (re-aimed, see
README): a text classifier (tokenize -> hashed TF-IDF -> logistic
regression) and a GBT classifier over (model score, length, word count).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import ustrip
from ..functions.text import text_length, word_count
from .boosting import train_with_patience

SEED = 42
VALIDATION_SHARE = 0.15
MAX_TOKENS = 128
SPLIT_BUCKETS = 1 << 16


def orient_score(is_leak_label, p, text) -> F.Column:
    """M1: probability of the leak class: p when the classifier's top label
    is the leak class, else 1 - p; 3 dp (DECIMAL, half-up); blank or null
    text -> 0. ``is_leak_label`` is a boolean column."""
    pd = p.cast("decimal(20,10)")
    s = F.when(is_leak_label, pd).otherwise(F.lit(Decimal(1)) - pd)
    blank = text.isNull() | (F.length(ustrip(text)) == 0)
    return F.when(blank, F.lit(0.0)).otherwise(F.round(s, 3).cast("double"))


def clean_labels_strict(df: DataFrame) -> DataFrame:
    """M3: text and label present, label numeric and 0/1, as INT.
    ``try_cast``: ANSI mode would make a plain cast fail on 'x'."""
    x = df.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    lab = F.expr("try_cast(label AS DOUBLE)")
    return x.withColumn("label_num", lab).where(F.col("label_num").isin(0.0, 1.0)) \
        .withColumn("label", F.col("label_num").cast("int")).drop("label_num")


def clean_labels_loose(df: DataFrame) -> DataFrame:
    """M4: label coerced to a number (bad -> dropped), text present,
    truncated to INT; other label values stay."""
    lab = F.expr("try_cast(label AS DOUBLE)")
    x = df.withColumn("label_num", lab).where(F.col("label_num").isNotNull() & F.col("text").isNotNull())
    return x.withColumn("label", F.col("label_num").cast("int")).drop("label_num")


def label_stats(df: DataFrame) -> DataFrame:
    """M5: rows per label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def stratified_split(df: DataFrame, key: str = "id", share: float = VALIDATION_SHARE,
                     seed: int = SEED, buckets: int = SPLIT_BUCKETS) -> DataFrame:
    """M6: exact, deterministic stratified split. Within each label rows are
    ordered by md5(seed || key); the first round(share * n_label) are
    validation rows.

    No text is shuffled and no label is ranked as a whole (it can hold half
    the data): counts of ``buckets`` hash-prefix buckets (the prefix keeps
    the md5 order) name the one bucket of each label in which the cut
    falls, the keys of that bucket alone are ranked, and every row is
    compared with its label's cut, a table of one row per label. Rows of
    equal key go to the same side.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    digits = len(f"{buckets - 1:x}")  # hex digits of the md5 prefix (65536 -> 4)
    keys = df.select("label", F.struct(h.alias("h"), F.col(key).alias("k")).alias("_at")).withColumn(
        "_b", F.conv(F.substring("_at.h", 1, digits), 16, 10).cast("int"))
    counts = keys.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    need = F.round(F.sum("_c").over(Window.partitionBy("label")) * F.lit(share)).cast("long") - F.coalesce(F.sum("_c").over(before), F.lit(0))
    edge = counts.withColumn("_need", need).where("_need BETWEEN 1 AND _c").select("label", "_b", "_need")
    cut = (keys.join(edge, ["label", "_b"])
               .withColumn("_r", F.row_number().over(Window.partitionBy("label", "_b").orderBy("_at")))
               .where("_r = _need").select("label", F.col("_at").alias("_cut")))
    x = df.join(cut, "label", "left")
    low = F.struct(h.alias("h"), F.col(key).alias("k")) <= F.col("_cut")
    return x.select(*df.columns, F.coalesce(low, F.lit(False)).alias("is_validation"))


def build_features(df: DataFrame, score_col: str = "model_score") -> DataFrame:
    """M7: (model score, text length, word count)."""
    return df.withColumn("text_length", text_length(F.col("text")).cast("int")) \
             .withColumn("word_count", word_count(F.col("text")).cast("int")) \
             .withColumn(score_col, F.col(score_col).cast("double"))


def tokenize_truncate(text, max_tokens: int = MAX_TOKENS) -> F.Column:
    """Lower-cased whitespace tokens, at most ``max_tokens``."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))
    return F.slice(toks, 1, max_tokens)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of predictions equal to the label."""
    return df.agg(F.avg((F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).cast("bigint").alias("n"))


def train_gbt(features: DataFrame, max_iter: int = 500, step_size: float = 0.05, max_depth: int = 6,
              seed: int = SEED, patience: int = 50):
    """M8: gradient-boosted trees on (model_score, text_length, word_count), cut at the round of the
    best validation accuracy; training ends after ``patience`` rounds without a better one."""
    return train_with_patience(features, max_iter, step_size, max_depth, seed, patience)[0]


def train_text_classifier(train: DataFrame, reg_params=(0.0, 0.01, 0.1),
                          num_features: int = 1 << 18, max_iter: int = 50):
    """A text classifier without epochs: tokens of the whole text -> hashed TF -> IDF -> logistic
    regression by L-BFGS; the regParam with the best validation accuracy wins. M9
    trains by epochs (``epochs.train_by_epochs``)."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, SQLTransformer

    tok = SQLTransformer(statement=(
        "SELECT *, regexp_extract_all(lower(text), '(?U)[^\\\\s\\\\x1c-\\\\x1f]+', 0) AS tokens FROM __THIS__"))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    fit_rows = train.where(~F.col("is_validation"))
    val_rows = train.where(F.col("is_validation"))
    prep = Pipeline(stages=[tok, tf, idf]).fit(fit_rows)
    features = prep.transform(fit_rows).select("label", "features")
    best, best_acc = None, -1.0
    for rp in reg_params:
        lr = LogisticRegression(labelCol="label", featuresCol="features", regParam=rp, maxIter=max_iter)
        model = PipelineModel(stages=[*prep.stages, lr.fit(features)])
        acc = accuracy(model.transform(val_rows)).first()["accuracy"] or 0.0
        if acc > best_acc:
            best, best_acc = model, acc
    return best


def score_with_model(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """M2: model score column from any fitted pipeline with a ``probability``
    output; no model -> score 0 (the reference's missing-model path). The
    model reads a column ``text``; another ``text_col`` stands in for it."""
    if model is None:
        return df.withColumn("model_score", F.lit(0.0))
    from pyspark.ml.functions import vector_to_array
    other = text_col != "text"
    rows = df.withColumn("_own", F.col("text")).withColumn("text", F.coalesce(text_col, F.lit(""))) if other else df
    p1 = vector_to_array(F.col("probability"))[1]
    out = model.transform(rows).withColumn("model_score", orient_score(F.lit(True), p1, F.col(text_col)))
    return out.select(*[F.col("_own").alias(c) if other and c == "text" else F.col(c) for c in df.columns], "model_score")
