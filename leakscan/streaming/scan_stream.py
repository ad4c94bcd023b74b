"""Structured Streaming scan of landed messages.

readStream (file source) -> ``scanned`` -> micro-batch -> ``store_batch``:

* R1: ``scanned`` keeps registered sources (left-semi join, the registry is a small
  dimension), analyzes (scan, dedup, score, OCR join of media messages)
  and keeps alert candidates. It is part of the stream's own plan, which is built when the stream starts
  and not by each micro-batch; a batch runs it once, into its staged rows.
* R3: rows without a message key pass by the scan and go to a dead-letter folder of the batch;
  the rest of the batch goes on.
* R2: candidates are deduplicated by key, and an alert is written at most once ever: keys that *earlier* batches
  alerted are removed (left-anti join) by the key index, of which a batch
  reads what its candidates fall into. No streaming state is kept;
  a batch never removes its own rows, so a replay rewrites them.
* R4: each batch writes ``batch_id=<i>`` with overwrite, so a replayed
  micro-batch (after a failure between write and commit) produces the
  same rows once. Alerts and the processed mark cannot diverge because
  they are one write.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import alert_candidates, build_alerts
from ..sources import key_index
from ..sources.messages import MESSAGE_SCHEMA

KEYS = ["chat_id", "message_id"]
STREAM_AQE = "spark.sql.adaptive.streaming.stateless.enabled"


def read_message_stream(spark: SparkSession, path: str, glob: str | None = None,
                        max_files_per_trigger: int | None = None, schema: str = MESSAGE_SCHEMA) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if its folder is absent or holds no file yet. Any other
    failure is raised: taking it for an empty table would write every alert again."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _alerted_before(spark: SparkSession, alerts_path: str, batch_id: int) -> DataFrame | None:
    """Keys of all earlier batches by the alert table itself."""
    prior = read_if_there(spark, alerts_path)
    if prior is None or "batch_id" not in prior.columns:
        return None
    return prior.where(F.col("batch_id") < batch_id).select(*KEYS)


def scanned(messages: DataFrame, *, sources: DataFrame | None, ocr: DataFrame | None, created_at=None, model=None) -> DataFrame:
    """What is stored of messages, of a stream's or a table's: a row is either ``bad``, a message without a
    key as it came, or ``alert``, the alert row of a candidate. Without ``created_at`` the alerts carry the
    time of the run; in a stream it is the time logged with the batch's offsets, which a replay repeats."""
    no_key = F.col("chat_id").isNull() | F.col("message_id").isNull()
    bad = messages.where(no_key).select(F.struct(*messages.columns).alias("bad"))
    good = messages.where(~no_key)
    if sources is not None:
        good = good.join(sources.select("chat_id"), "chat_id", "left_semi")
    ts = created_at if created_at is not None else F.current_timestamp()
    alerts = build_alerts(alert_candidates(good, ocr, None, model), ts)
    alert = F.struct(
        F.col("chat_id").cast("bigint").alias("chat_id"), F.col("message_id").cast("bigint").alias("message_id"),
        F.col("sx_score").cast("float").alias("sx_score"), F.col("model_score").cast("float").alias("model_score"),
        "text_preview", "leaks", "ocr_text", "sender",
        F.date_trunc("millisecond", "date").alias("date"),
        F.date_trunc("millisecond", "created_at").alias("created_at"))
    return alerts.select(alert.alias("alert")).unionByName(bad, allowMissingColumns=True)


def store_batch(rows: DataFrame, batch_id: int, *, alerts_path: str, dead_letter_path: str, keys_path: str | None = None,
                spark: SparkSession | None = None) -> None:
    """One micro-batch of ``scanned`` rows. They are made once, into a folder beside the table (``-staged``), and
    read there; the keys of the candidates are looked up in the
    key index (``keys_path``, by default beside the table), not in the alert table. Every write of a batch overwrites the same
    folder, so a replay after a failure at any point leaves what one run leaves. ``spark`` reads and writes what
    follows the staged rows; a stream's own session isn't adaptive (``_planned_once``)."""
    spark = spark or rows.sparkSession
    keys_path = keys_path or f"{alerts_path.rstrip('/')}-keys"
    staged = f"{alerts_path.rstrip('/')}-staged/batch_id={batch_id}"
    rows.write.mode("overwrite").parquet(staged)
    made = spark.read.schema(rows.schema).parquet(staged)
    (made.where("bad IS NOT NULL").select("bad.*").withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{dead_letter_path}/batch_id={batch_id}"))
    # duplicates only matter among alert candidates: deduplicate those (few)
    # instead of shuffling the whole micro-batch with its texts
    cands = made.where("alert IS NOT NULL").select("alert.*").dropDuplicates(KEYS)
    if not key_index.known(spark, keys_path, batch_id):
        key_index.ensure(spark, keys_path, batch_id, _alerted_before(spark, alerts_path, batch_id))
    key_index.compact(spark, keys_path, batch_id)
    fresh = key_index.without_known(cands, keys_path, batch_id)
    target = f"{alerts_path}/batch_id={batch_id}"
    (fresh.select(*cands.columns).withColumn("month", F.date_format("created_at", "yyyyMM"))
          .write.mode("overwrite").partitionBy("month").parquet(target))
    # a batch without alerts leaves no readable schema
    key_index.write_keys(spark.read.schema(cands.schema).parquet(target), keys_path, batch_id)


def process_batch(batch: DataFrame, batch_id: int, *, sources: DataFrame | None, ocr: DataFrame | None,
                  alerts_path: str, dead_letter_path: str, created_at=None, model=None, keys_path: str | None = None) -> None:
    """One micro-batch of messages as they landed (also callable on a static DataFrame for replays)."""
    store_batch(scanned(batch, sources=sources, ocr=ocr, created_at=created_at, model=model), batch_id,
                alerts_path=alerts_path, dead_letter_path=dead_letter_path, keys_path=keys_path)


def start_scan_stream(messages: DataFrame, *, sources: DataFrame | None, ocr: DataFrame | None,
                      alerts_path: str, dead_letter_path: str, checkpoint_path: str,
                      trigger: dict | None = None, created_at=None, model=None):
    """Start the stream. ``trigger`` defaults to a 5-minute processing
    time (the reference polls every 5 minutes); tests use availableNow.
    ``model`` scores messages that bring no ``model_score``."""
    trigger = trigger or {"processingTime": "5 minutes"}

    spark = messages.sparkSession

    def fn(rows, i):
        store_batch(rows, i, alerts_path=alerts_path, dead_letter_path=dead_letter_path, spark=spark)

    rows = scanned(messages, sources=sources, ocr=ocr, created_at=created_at, model=model)
    with _planned_once(spark):
        return (rows.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint_path)
                .trigger(**trigger).start())


@contextmanager
def _planned_once(spark: SparkSession):
    """A stream that starts in here is not planned adaptively. Adaptive execution reports each change of a
    plan, and for such a report Spark plans the whole query of a stream anew: 27 detectors, several times a batch.
    A stream copies the settings when it starts; the session's are put back."""
    was = spark.conf.get(STREAM_AQE, None)
    spark.conf.set(STREAM_AQE, "false")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(STREAM_AQE)
        else:
            spark.conf.set(STREAM_AQE, was)


def read_stream_alerts(spark: SparkSession, alerts_path: str) -> DataFrame:
    return spark.read.parquet(alerts_path)
