"""Analysis of messages into alerts and report shapes.

A1 is one narrow stage per message (compose, scan, dedup, score) plus
two key joins: OCR text of media messages and the processed-key
existence join. No collect, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import (compose_full_text, leaks_to_json, message_text, parse_message_date,
                              safe_clean_text, sender_to_json, text_preview, truncate_words)
from ..sources.registry import with_processed_flag
from .analyze import scan_and_score
from .training import score_with_model


def score_messages(msgs: DataFrame, ocr: DataFrame | None, model=None) -> DataFrame:
    """A1 without the processed flag: whole text (+ OCR text of media
    messages) -> findings, model score, risk score. Messages without a
    column ``model_score`` are scored by ``model`` over text and OCR text
    (no model: 0).

    Only media messages can carry OCR text, so only they take part in the
    OCR join (one shuffle of the media subset); all other messages stay in
    place. The OCR side is left to Catalyst/AQE: broadcast when its
    measured size is under the broadcast threshold, shuffle join beyond.
    """
    m = msgs.withColumn("text", message_text(F.col("text"), None))
    if ocr is not None:
        # message ids are per chat; one text per message, whatever the table holds
        o = ocr.groupBy("chat_id", "message_id").agg(F.min("ocr_text").alias("_ocr"))
        media = (m.where(F.col("media")).join(o, ["chat_id", "message_id"], "left")
                  .withColumn("ocr_raw", F.coalesce(F.col("_ocr"), F.lit(""))).drop("_ocr"))
        other = m.where(~F.coalesce(F.col("media"), F.lit(False))).withColumn("ocr_raw", F.lit(""))
        # the scan is planned once, after the union, and not once per branch
        m = finished_rows(media.unionByName(other))
    else:
        m = m.withColumn("ocr_raw", F.lit(""))
    m = m.withColumn("full_text", compose_full_text(F.col("text"), F.col("ocr_raw")))
    if "model_score" not in m.columns:
        m = score_with_model(m, model, "full_text").withColumn("model_score", F.col("model_score").cast("decimal(5,3)"))
    return scan_and_score(m, text_col="full_text", model_col="model_score")


def _response_columns(scored: DataFrame, alert) -> DataFrame:
    return scored.select(
        "chat_id", "message_id", "date", "sender_id", "text", "is_forward", "out", "media",
        "full_text", "findings", "raw_findings",
        F.col("model_score_eff").cast("double").alias("model_score"),
        "sx_score", alert.alias("alert"),
        (F.col("ocr_raw") != "").alias("has_ocr"),
        safe_clean_text(F.col("ocr_raw")).alias("ocr_text"),
        "sender")


def analyze_messages(msgs: DataFrame, ocr: DataFrame | None, processed: DataFrame | None) -> DataFrame:
    """A1 + A2: response rows for every message with findings, scores, OCR
    fields and the alert flag (score > 0.55 and key not processed). The
    rows are finished: predicates on them don't reach into the scan.

    ``ocr``: (chat_id, message_id, ocr_text) for media messages with an image;
    ``processed``: (chat_id, message_id) keys already alerted.
    """
    # the existence join runs before the scan: if it shuffles, it moves the
    # raw message rows, not texts plus findings arrays. The number of partitions is stated: by the bytes
    # that it reads, adaptive execution would make one task a core of the scan, and the largest decides.
    if processed is not None:
        n = int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        msgs = with_processed_flag(msgs.repartition(n, "chat_id", "message_id"), processed)
    else:
        msgs = msgs.withColumn("is_processed", F.lit(False))
    scored = score_messages(msgs, ocr)
    return finished_rows(_response_columns(scored, (F.col("sx_score") > float(C.ALERT_THRESHOLD)) & ~F.col("is_processed")))


def alert_candidates(msgs: DataFrame, ocr: DataFrame | None, processed: DataFrame | None, model=None) -> DataFrame:
    """A2 for the alert path: rows scoring above 0.55 whose key is not
    processed. The score filter is narrow and comes first, so only the
    (few) candidates meet the processed keys in the anti join; the whole
    corpus is never shuffled for it."""
    scored = score_messages(msgs, ocr, model)
    scored = scored.withColumn("_cand", F.col("sx_score") > float(C.ALERT_THRESHOLD))
    cands = keep_rows(scored, "_cand").drop("_cand")
    if processed is not None:
        cands = cands.join(processed.select("chat_id", "message_id").distinct(), ["chat_id", "message_id"], "left_anti")
    return _response_columns(cands, F.lit(True))


def finished_rows(df: DataFrame) -> DataFrame:
    """The same rows behind a plan barrier (a generator of one row each).

    Catalyst moves predicates and projections below other projections and
    unions by substituting expressions; with the scan among them a filter on
    two columns of the result plans 27 detectors several times and takes
    minutes. References to a generator's output stay above it, so what is
    asked of these rows later is evaluated on their values."""
    cols = df.columns
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))


def keep_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean column ``flag`` is true, without a Filter node.

    A plain ``where(flag)`` lets Catalyst push the predicate below the
    projections that compute the risk score and substitute the whole
    scan/fold expression into it (the 27-detector scan then runs several
    times per row). Selecting through a generator over the finished row
    keeps one evaluation per row; the stage stays narrow.
    """
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    kept = F.filter(F.array(row), lambda r: F.coalesce(r[flag], F.lit(False)))
    return df.select(F.inline(kept)).select(*cols)


def build_alerts(analyzed: DataFrame, created_at) -> DataFrame:
    """A3: rows to store for alerting messages (preview of text + OCR,
    findings and sender as JSON, parsed message date)."""
    a = keep_rows(analyzed, "alert")
    return a.select(
        "chat_id", "message_id", "sx_score", "model_score",
        text_preview(F.col("full_text")).alias("text_preview"),
        leaks_to_json(F.col("findings")).alias("leaks"),
        "ocr_text",
        sender_to_json(F.col("sender")).alias("sender"),
        parse_message_date(F.col("date"), created_at).alias("date"),
        created_at.alias("created_at"))


def alerts_response(analyzed: DataFrame) -> DataFrame:
    """A4: alert list of the scan response (preview of the text only,
    raw date)."""
    return keep_rows(analyzed, "alert").select(
        "chat_id", "message_id", "sx_score", "model_score",
        text_preview(F.col("text")).alias("text_preview"),
        leaks_to_json(F.col("findings")).alias("leaks"),
        "has_ocr", "ocr_text", sender_to_json(F.col("sender")).alias("sender"), "date")


def messages_count(analyzed: DataFrame) -> DataFrame:
    """Analyzed messages per chat (partial count per task, then merge)."""
    return analyzed.groupBy("chat_id").agg(F.count(F.lit(1)).cast("bigint").alias("messages_count"))


def dashboard_summary(sources: DataFrame, recent_filtered: DataFrame) -> DataFrame:
    """Number of sources and of recent source-filtered alerts."""
    a = sources.agg(F.count(F.lit(1)).cast("bigint").alias("sources_count"))
    b = recent_filtered.agg(F.count(F.lit(1)).cast("bigint").alias("recent_alerts"))
    return a.crossJoin(b)  # two one-row aggregates


def risk_band(score) -> F.Column:
    """A10."""
    return F.when(score > C.RISK_RED_ABOVE, F.lit("red")).otherwise(F.lit("yellow"))


def leak_list_text(leaks) -> F.Column:
    """A11: 'type: value' lines."""
    return F.array_join(F.transform(leaks, lambda x: F.concat(x["type"], F.lit(": "), x["value"])), "\n")


def ocr_column_text(ocr_text) -> F.Column:
    """A12."""
    return truncate_words(ocr_text, 100)


def filter_flag(value: str | None) -> bool:
    """The page's source filter is on for a case-insensitive 'true'."""
    return (value or "false").lower() == "true"
