"""Registered streaming queries (R1-R4): each lands the derived messages
as files, runs the stream with ``availableNow`` and returns what the sink
holds afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.landing import land_messages
from ..sources.messages import MESSAGE_SCHEMA
from ..streaming import scan_stream as SS
from ..streaming.isolated import start_isolated_stream
from . import fixtures as FX
from . import oracle as O
from .report_queries import reg

STREAM_SCHEMA = MESSAGE_SCHEMA + ", model_score DECIMAL(5,3)"


def _paths(spark, tag):
    base = scratch_path(spark, f"stream-{tag}-{uuid.uuid4().hex}")
    return {k: f"{base}/{k}" for k in ("input", "alerts", "dead", "checkpoint", "sources", "ocr")}


def _kept(df, path):
    """The same rows, made once: a micro-batch reads them and doesn't make them anew from the tables."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sides(spark, sf, p):
    return dict(sources=_kept(FX.sources(spark, sf), p["sources"]), ocr=_kept(FX.ocr_for_messages(spark, sf), p["ocr"]))


def _land(spark, sf, path, copies=1, corrupt=False):
    m = FX.msgs(spark, sf)
    if corrupt:
        m = m.withColumn("chat_id", F.when(F.col("message_id") % 97 == 0, F.lit(None).cast("bigint"))
                         .otherwise(F.col("chat_id")))
    for _ in range(copies):
        land_messages(m, path)


def _run(spark, sf, p, max_files=None):
    stream = SS.read_message_stream(spark, p["input"], max_files_per_trigger=max_files, schema=STREAM_SCHEMA)
    q = SS.start_scan_stream(stream, **_sides(spark, sf, p),
                             alerts_path=p["alerts"], dead_letter_path=p["dead"], checkpoint_path=p["checkpoint"],
                             trigger={"availableNow": True}, created_at=F.lit(FX.BATCH_TS).cast("timestamp"))
    q.awaitTermination()
    return q


def _alerts_out(spark, path):
    a = SS.read_stream_alerts(spark, path)
    return a.select("chat_id", "message_id", F.col("sx_score").cast("double").alias("sx_score"))


_STREAM_ORACLE = f"""WITH {O.analyzed_ctes()}
SELECT chat_id, message_id, CAST(CAST(sx_score AS FLOAT) AS DOUBLE) AS sx_score FROM an
WHERE sx_score > 0.55 AND chat_id % 3 = 0"""


@reg("stream_scan", _STREAM_ORACLE)
def q_stream_scan(spark, sf):
    """Every landed message of a registered source analyzed once."""
    p = _paths(spark, "scan")
    _land(spark, sf, p["input"])
    _run(spark, sf, p)
    return _alerts_out(spark, p["alerts"])


@reg("stream_dedup_alerts", _STREAM_ORACLE)
def q_stream_dedup(spark, sf):
    """R2: the same messages land twice, in several micro-batches; each
    alert is stored once."""
    p = _paths(spark, "dedup")
    _land(spark, sf, p["input"], copies=2)
    _run(spark, sf, p, max_files=2)
    return _alerts_out(spark, p["alerts"])


@reg("stream_isolate_source_errors", f"""
SELECT message_id FROM ({O.msgs_sql()}) m WHERE message_id % 97 = 0""")
def q_stream_errors(spark, sf):
    """Rows without a key go to the dead-letter folder, the rest goes on."""
    p = _paths(spark, "errors")
    _land(spark, sf, p["input"], corrupt=True)
    _run(spark, sf, p)
    return spark.read.parquet(p["dead"]).select("message_id")


@reg("stream_idempotent_sink", _STREAM_ORACLE)
def q_stream_replay(spark, sf):
    """Micro-batch 0 processed twice (a replay after a failure that
    followed the write) leaves the sink as after one run."""
    p = _paths(spark, "replay")
    _land(spark, sf, p["input"])
    batch = spark.read.schema(STREAM_SCHEMA).parquet(p["input"])
    kw = dict(**_sides(spark, sf, p), alerts_path=p["alerts"],
              dead_letter_path=p["dead"], created_at=F.lit(FX.BATCH_TS).cast("timestamp"))
    SS.process_batch(batch, 0, **kw)
    SS.process_batch(batch, 0, **kw)
    return _alerts_out(spark, p["alerts"])


@reg("stream_quarantine", _STREAM_ORACLE)
def q_stream_quarantine(spark, sf):
    """Messages land in a folder a source, beside files that can't be read; those go to the
    quarantine, and every message of the other files is analyzed."""
    p = _paths(spark, "quarantine")
    m = FX.landed(spark, sf)
    land_messages(m.withColumn("source", F.concat(F.lit("s"), F.pmod("chat_id", F.lit(4)).cast("string"))), p["input"], partition_by="source")
    m.limit(5).select(F.col("text").alias("value")).coalesce(1).write.text(f"{p['input']}/source=s9")
    start_isolated_stream(spark, p["input"], quarantine_path=f"{p['dead']}-files", checkpoint_path=p["checkpoint"], schema=STREAM_SCHEMA, glob="part-*",
                          trigger={"availableNow": True}, **_sides(spark, sf, p), alerts_path=p["alerts"],
                          dead_letter_path=p["dead"], created_at=F.lit(FX.BATCH_TS).cast("timestamp")).awaitTermination()
    if spark.read.parquet(f"{p['dead']}-files").where("source = 'source=s9'").isEmpty():
        raise RuntimeError("the broken files are not in the quarantine")
    return _alerts_out(spark, p["alerts"])
