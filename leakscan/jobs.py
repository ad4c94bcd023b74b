"""Cluster entry points.

    spark-submit --py-files leakscan.zip -m leakscan.jobs batch \\
        --messages s3://.../messages/ --alerts s3://.../alerts/ \\
        [--sources PATH] [--ocr PATH] [--model PATH] [--format parquet|json]

    ... -m leakscan.jobs stream --messages DIR --alerts PATH --checkpoint PATH [--trigger "5 minutes"]

The alert table is its own processed set: a batch run skips keys that
already have an alert, so reruns add nothing (once-ever alerts).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.alerts import alert_candidates, build_alerts
from .sources.alert_store import write_alerts
from .sources.messages import MESSAGE_SCHEMA
from .sources.training_csv import load_model
from .streaming import scan_stream as SS

KEYS = ["chat_id", "message_id"]


def _read(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def _existing_alert_keys(spark: SparkSession, alerts_path: str) -> DataFrame | None:
    prior = SS.read_if_there(spark, alerts_path)
    return None if prior is None else prior.select(*KEYS).distinct()


def batch_job(spark: SparkSession, messages: str, alerts: str, sources: str | None = None, ocr: str | None = None,
              model: str | None = None, fmt: str = "parquet") -> None:
    msgs = _read(spark, messages, fmt, MESSAGE_SCHEMA if fmt == "json" else None)
    if sources:
        msgs = msgs.join(_read(spark, sources, "parquet").select("chat_id").distinct(), "chat_id", "left_semi")
    ocr_df = _read(spark, ocr, "parquet").select(*KEYS, "ocr_text") if ocr else None
    fitted = load_model(model) if model else None
    cands = alert_candidates(msgs, ocr_df, _existing_alert_keys(spark, alerts), fitted).dropDuplicates(KEYS)
    write_alerts(build_alerts(cands, F.current_timestamp()), alerts, mode="append")


def stream_job(spark: SparkSession, messages: str, alerts: str, checkpoint: str, dead_letter: str,
               sources: str | None = None, ocr: str | None = None, trigger: str = "5 minutes",
               model: str | None = None):
    """With ``model`` every message is scored by it; else the landed files bring ``model_score``."""
    stream = SS.read_message_stream(spark, messages, schema=MESSAGE_SCHEMA + ("" if model else ", model_score DECIMAL(5,3)"))
    src = _read(spark, sources, "parquet") if sources else None
    ocr_df = _read(spark, ocr, "parquet").select(*KEYS, "ocr_text") if ocr else None
    return SS.start_scan_stream(stream, sources=src, ocr=ocr_df, alerts_path=alerts, dead_letter_path=dead_letter,
                                checkpoint_path=checkpoint, trigger={"processingTime": trigger},
                                model=load_model(model) if model else None)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="leakscan.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    b.add_argument("--messages", required=True)
    b.add_argument("--alerts", required=True)
    b.add_argument("--sources")
    b.add_argument("--ocr")
    b.add_argument("--model")
    b.add_argument("--format", default="parquet")
    s = sub.add_parser("stream")
    s.add_argument("--messages", required=True)
    s.add_argument("--alerts", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--dead-letter", required=True)
    s.add_argument("--sources")
    s.add_argument("--ocr")
    s.add_argument("--model")
    s.add_argument("--trigger", default="5 minutes")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"leakscan-{a.cmd}").getOrCreate()
    if a.cmd == "batch":
        batch_job(spark, a.messages, a.alerts, a.sources, a.ocr, a.model, a.format)
    else:
        stream_job(spark, a.messages, a.alerts, a.checkpoint, a.dead_letter, a.sources, a.ocr, a.trigger, a.model).awaitTermination()


if __name__ == "__main__":
    main()
