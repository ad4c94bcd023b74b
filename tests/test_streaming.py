"""Stream = batch, replay adds nothing, bad rows isolated."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leakscan.plans import fixtures as FX
from leakscan.plans import stream_queries as SQ
from leakscan.streaming import scan_stream as SS


def keys(df):
    return sorted((r.chat_id, r.message_id) for r in df.select("chat_id", "message_id").collect())


def test_stream_equals_batch(spark):
    stream = SQ.q_stream_scan(spark, SF_SMALL)
    from leakscan.operators.alerts import keep_rows
    batch = keep_rows(FX.analyzed(spark, SF_SMALL).where(F.col("chat_id") % 3 == 0)
                      .withColumn("a", F.col("sx_score") > 0.55), "a")
    assert keys(stream) == keys(batch)


def test_replay_and_later_duplicates(spark):
    p = SQ._paths(spark, "t")
    SQ._land(spark, SF_SMALL, p["input"])
    batch = spark.read.schema(SQ.STREAM_SCHEMA).parquet(p["input"])
    kw = dict(sources=None, ocr=None, alerts_path=p["alerts"], dead_letter_path=p["dead"],
              created_at=F.lit(FX.BATCH_TS).cast("timestamp"))
    SS.process_batch(batch, 0, **kw)
    first = keys(spark.read.parquet(p["alerts"]))
    SS.process_batch(batch, 0, **kw)          # replay of batch 0
    assert keys(spark.read.parquet(p["alerts"])) == first
    SS.process_batch(batch, 1, **kw)          # the same messages arrive again later
    assert keys(spark.read.parquet(p["alerts"])) == first
    assert first


def test_dead_letter(spark):
    dead = SQ.q_stream_errors(spark, SF_SMALL)
    ids = [r.message_id for r in dead.collect()]
    assert ids and all(i % 97 == 0 for i in ids)


def test_old_and_undated_messages_lose_no_alert(spark):
    p = SQ._paths(spark, "old")
    SQ._land(spark, SF_SMALL, p["input"])
    rows = spark.read.schema(SQ.STREAM_SCHEMA).parquet(p["input"])
    want = keys(rows_alerts(spark, rows))
    part = F.pmod(F.col("message_id"), F.lit(4))
    for k in (1, 0, 3, 2):      # undated first, old ones last
        d = rows.where(part == k).withColumn("date", F.when(part == 1, F.lit(None)).when(part == 2, F.lit("2001-01-01T00:00:00")).otherwise(F.col("date")))
        d.coalesce(1).write.mode("append").parquet(p["input"] + "-parts")
    stream = SS.read_message_stream(spark, p["input"] + "-parts", max_files_per_trigger=1, schema=SQ.STREAM_SCHEMA)
    SS.start_scan_stream(stream, sources=None, ocr=None, alerts_path=p["alerts"], dead_letter_path=p["dead"],
                         checkpoint_path=p["checkpoint"], trigger={"availableNow": True}).awaitTermination()
    assert keys(spark.read.parquet(p["alerts"])) == want and want


def rows_alerts(spark, rows):
    from leakscan.operators.alerts import alert_candidates
    return alert_candidates(rows.where("chat_id IS NOT NULL AND message_id IS NOT NULL"), None, None).dropDuplicates(SS.KEYS)


def test_unreadable_alert_table_fails(spark):
    import pytest
    p = SQ._paths(spark, "bad")
    spark.range(3).selectExpr("string(id) AS value").write.text(p["alerts"])
    with pytest.raises(Exception):
        SS.read_if_there(spark, p["alerts"]).count()
    assert SS.read_if_there(spark, p["alerts"] + "-none") is None
