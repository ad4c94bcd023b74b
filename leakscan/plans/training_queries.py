"""Registered queries for model score, labels, features and training
(M1-M11, S6, S15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import subwords as SW
from ..operators import training as TR
from ..operators.boosting import best_round, train_with_patience
from ..operators.epochs import train_by_epochs
from ..session import scratch_path
from ..sources import training_csv as TC
from . import fixtures as FX
from . import oracle as O
from .report_queries import reg

# model probability of the fixture: a 4-decimal value per document
_P_SQL = "CAST((doc_id * 7919) % 10000 AS DOUBLE) / 10000.0"


def _prob_table(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "text")
    lab = FX.table(spark, sf, "labels").select("doc_id", "toxic")
    p = ((F.col("doc_id") * 7919) % 10000).cast("double") / F.lit(10000.0)
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
        F.when(F.col("toxic") == 1, F.lit("LABEL_1")).otherwise(F.lit("LABEL_0")).alias("label"), p.alias("p"))


@reg("orient_score", f"""
SELECT CAST(d.doc_id AS BIGINT) AS doc_id,
       CASE WHEN d.text IS NULL OR regexp_full_match(d.text, '{O.WS}*') THEN 0.0
            ELSE CAST(round(CASE WHEN l.toxic = 1 THEN CAST({_P_SQL.replace('doc_id', 'd.doc_id')} AS DECIMAL(20,10))
                                 ELSE 1 - CAST({_P_SQL.replace('doc_id', 'd.doc_id')} AS DECIMAL(20,10)) END, 3) AS DOUBLE) END AS model_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_orient(spark, sf):
    t = _prob_table(spark, sf)
    return t.select("doc_id", TR.orient_score(F.col("label") == "LABEL_1", F.col("p"), F.col("text")).alias("model_score"))


_TRAIN_SQL = """
SELECT CAST(d.doc_id AS BIGINT) AS id, d.text,
       CASE WHEN d.doc_id % 17 = 0 THEN 'x' WHEN d.doc_id % 19 = 0 THEN '2' ELSE CAST(l.toxic AS VARCHAR) END AS label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
_STRICT_SQL = f"""SELECT id, text, CAST(TRY_CAST(label AS DOUBLE) AS INTEGER) AS label FROM ({_TRAIN_SQL}) t
WHERE text IS NOT NULL AND label IS NOT NULL AND TRY_CAST(label AS DOUBLE) IN (0, 1)"""
_LOOSE_SQL = f"""SELECT id, text, CAST(TRY_CAST(label AS DOUBLE) AS INTEGER) AS label FROM ({_TRAIN_SQL}) t
WHERE text IS NOT NULL AND TRY_CAST(label AS DOUBLE) IS NOT NULL"""


@reg("clean_labels_strict", f"SELECT id, label FROM ({_STRICT_SQL}) s")
def q_strict(spark, sf):
    return TR.clean_labels_strict(FX.training(spark, sf)).select("id", "label")


@reg("clean_labels_loose", f"SELECT id, label FROM ({_LOOSE_SQL}) s")
def q_loose(spark, sf):
    return TR.clean_labels_loose(FX.training(spark, sf)).select("id", "label")


@reg("label_stats", f"SELECT label, CAST(count(*) AS BIGINT) AS n FROM ({_LOOSE_SQL}) s GROUP BY label")
def q_label_stats(spark, sf):
    return TR.label_stats(TR.clean_labels_loose(FX.training(spark, sf)))


@reg("stratified_split", f"""
SELECT id, label, rn <= CAST(round(n * 0.15) AS BIGINT) AS is_validation FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM ({_STRICT_SQL}) s) t""")
def q_split(spark, sf):
    return TR.stratified_split(TR.clean_labels_strict(FX.training(spark, sf))).select("id", "label", "is_validation")


@reg("build_features", f"""
SELECT s.id, CASE WHEN s.text IS NULL OR regexp_full_match(s.text, '{O.WS}*') THEN 0.0
                  ELSE CAST(round(CASE WHEN s.label = 1 THEN CAST({_P_SQL.replace('doc_id', 's.id')} AS DECIMAL(20,10))
                                       ELSE 1 - CAST({_P_SQL.replace('doc_id', 's.id')} AS DECIMAL(20,10)) END, 3) AS DOUBLE) END AS model_score,
       CAST(length(s.text) AS INTEGER) AS text_length, CAST({O.word_count_sql('s.text')} AS INTEGER) AS word_count, s.label
FROM ({_STRICT_SQL}) s""")
def q_features(spark, sf):
    return _features(spark, sf).select("id", "model_score", "text_length", "word_count", "label")


def _features(spark, sf):
    s = TR.clean_labels_strict(FX.training(spark, sf))
    p = ((F.col("id") * 7919) % 10000).cast("double") / F.lit(10000.0)
    s = s.withColumn("model_score", TR.orient_score(F.col("label") == 1, p, F.col("text")))
    return TR.build_features(s)


@reg("tokenize_truncate", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       array_to_string(list_slice(regexp_extract_all(lower(text), '[^{O.WSI}]+', 0), 1, 128), ' ') AS tokens,
       CAST(len(list_slice(regexp_extract_all(lower(text), '[^{O.WSI}]+', 0), 1, 128)) AS BIGINT) AS n_tokens
FROM documents""")
def q_tokens(spark, sf):
    d = FX.table(spark, sf, "documents")
    t = TR.tokenize_truncate(F.col("text"))
    return d.select(F.col("doc_id").cast("bigint"), F.array_join(t, " ").alias("tokens"), F.size(t).cast("bigint").alias("n_tokens"))


@reg("accuracy", """
SELECT avg(CAST(CAST(toxic AS DOUBLE) = CAST(quality AS DOUBLE) AS DOUBLE)) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM labels""")
def q_accuracy(spark, sf):
    lab = FX.table(spark, sf, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return TR.accuracy(lab)


@reg("read_training_csv", f"SELECT CAST(id AS VARCHAR) AS id, text, label FROM ({_TRAIN_SQL}) t")
def q_read_csv(spark, sf):
    """S6 round trip: the training rows written as ';' CSV, read back."""
    path = scratch_path(spark, f"training-csv-{uuid.uuid4().hex}")
    TC.write_training_csv(FX.training(spark, sf), path)
    return TC.read_training_csv(spark, path).select("id", "text", "label")


# --- training and model persistence: checked on rows and by pytest ---------------
@reg("train_gbt", None)
def q_gbt(spark, sf):
    """M8 on the features with the split's validation rows; cut at the best round."""
    f = TR.stratified_split(_features(spark, sf))
    model = TR.train_gbt(f)
    return model.transform(f.where(F.col("is_validation"))).select("id", "label", F.col("prediction").cast("int"))


@reg("gbt_rounds", None)
def q_gbt_rounds(spark, sf):
    """M8: validation accuracy after every trained round, and the round that is kept."""
    _, accuracies = train_with_patience(TR.stratified_split(_features(spark, sf)))
    best, _ = best_round(accuracies, 50)
    return spark.createDataFrame([(k, a, k == best) for k, a in enumerate(accuracies, 1)], "round int, accuracy double, kept boolean")


def _split(spark, sf):
    return TR.stratified_split(TR.clean_labels_strict(FX.training(spark, sf)))


@reg("train_text_classifier", None)
def q_text_clf(spark, sf):
    """M9: predictions of the best epoch on the validation rows."""
    s = _split(spark, sf)
    model, _ = train_by_epochs(s)
    return model.transform(s.where(F.col("is_validation"))).select("id", "label", F.col("prediction").cast("int"))


@reg("text_epochs", None)
def q_text_epochs(spark, sf):
    """M9: training loss and validation accuracy of every epoch, and the epoch that is kept."""
    _, metrics = train_by_epochs(_split(spark, sf))
    return spark.createDataFrame([(m["epoch"], m["train_loss"], m["accuracy"], m["best"]) for m in metrics],
                                 "epoch int, train_loss double, accuracy double, best boolean")


@reg("subword_tokens", None)
def q_subwords(spark, sf):
    """Subword ids of every text by longest match, padded to 128, with the mask."""
    import public_tokenizers
    pieces = SW.pieces_of_byte_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    t = SW.subword_tokens(d, pieces)
    return t.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("attention_mask", "").alias("attention_mask"), "n_pieces")


@reg("score_text", None)
def q_score_text(spark, sf):
    """M2: score every document with a trained text classifier."""
    model, _ = train_by_epochs(_split(spark, sf))
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return TR.score_with_model(d, model)


@reg("save_load_model", None)
def q_save_load(spark, sf):
    """Save, load, and score with the loaded model."""
    model, _ = train_by_epochs(_split(spark, sf))
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    TC.save_model(model, path)
    loaded = TC.load_model(path)
    d = FX.table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return TR.score_with_model(d, loaded)
