"""A broken file and a broken source leave the others running."""
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from leakscan.plans import fixtures as FX
from leakscan.plans import stream_queries as SQ
from leakscan.session import scratch_path
from leakscan.sources.landing import land_messages
from leakscan.streaming import isolated as I


def run(spark, base, **kw):
    I.start_isolated_stream(spark, f"{base}/land", quarantine_path=f"{base}/bad", checkpoint_path=f"{base}/cp", trigger={"availableNow": True},
                            sources=None, ocr=None, alerts_path=f"{base}/alerts", dead_letter_path=f"{base}/dead",
                            created_at=F.lit(FX.BATCH_TS).cast("timestamp"), **kw).awaitTermination()
    return spark.read.parquet(f"{base}/alerts"), spark.read.parquet(f"{base}/bad")


def land_by_source(spark, base):
    m = FX.msgs(spark, SF_SMALL)
    for c in (0, 1, 2):
        land_messages(m.where(F.pmod("chat_id", F.lit(3)) == c).coalesce(1), f"{base}/land/s{c}")
    return m


def test_broken_file_and_broken_source(spark):
    base = scratch_path(spark, f"isolated-{uuid.uuid4().hex}")
    m = land_by_source(spark, base)
    want = sorted((r.chat_id, r.message_id) for r in SQ_alerts(spark, m))
    # one file of source s1 is no Parquet, all of source s9 has another type
    spark.createDataFrame([("not a table",)], "value string").coalesce(1).write.mode("append").text(f"{base}/land/s1")
    m.limit(20).withColumn("message_id", F.array(F.col("message_id"))).coalesce(1).write.parquet(f"{base}/land/s9")
    alerts, bad = run(spark, base, schema=SQ.STREAM_SCHEMA, glob="part-*")
    assert sorted((r.chat_id, r.message_id) for r in alerts.collect()) == want and want
    rows = bad.collect()
    assert sorted(r.source for r in rows) == ["s1", "s9"]
    assert all(r.error and r.path.rsplit("/", 2)[1] == r.source for r in rows)


def SQ_alerts(spark, m):
    from leakscan.operators.alerts import alert_candidates
    return alert_candidates(m, None, None).dropDuplicates(["chat_id", "message_id"]).select("chat_id", "message_id").collect()


def test_json_records_that_do_not_fit(spark):
    base = scratch_path(spark, f"isolated-{uuid.uuid4().hex}")
    m = FX.msgs(spark, SF_SMALL).limit(60).cache()
    m.coalesce(1).write.json(f"{base}/land/a")
    spark.createDataFrame([('{"chat_id": "x", "message_id": 1, "text": "bad type"}',), ("{broken",)], "value string").coalesce(1).write.text(f"{base}/land/b")
    alerts, bad = run(spark, base, schema=SQ.STREAM_SCHEMA, fmt="json", glob="part-*")
    assert sorted((r.chat_id, r.message_id) for r in alerts.collect()) == sorted((r.chat_id, r.message_id) for r in SQ_alerts(spark, m))
    rows = bad.collect()
    assert sorted(r.record for r in rows) == ['{"chat_id": "x", "message_id": 1, "text": "bad type"}', "{broken"]
    assert {r.source for r in rows} == {"b"}
    m.unpersist()


def test_failure_without_a_broken_file_is_raised(spark):
    import pytest
    base = scratch_path(spark, f"isolated-{uuid.uuid4().hex}")
    land_by_source(spark, base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{base}/land").select("path", "length")
    with pytest.raises(Exception):
        I.process_files(files, 0, root=f"{base}/land", quarantine_path=f"{base}/bad", schema=SQ.STREAM_SCHEMA, sources=None,
                        ocr=spark.range(3).select(F.raise_error(F.lit("elsewhere")).cast("string").alias("ocr_text"), F.col("id").alias("chat_id"), F.col("id").alias("message_id")),
                        alerts_path=f"{base}/alerts", dead_letter_path=f"{base}/dead")


def test_source_names():
    assert I.source_of("file:///a/b/s1/x.parquet", "/a/b") == "s1"
    assert I.source_of("s3://a/b/s1/d/x.parquet", "s3://a/b/") == "s1"
    assert I.source_of("file:/a/b/x.parquet", "file:///a/b") == ""
