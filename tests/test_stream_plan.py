"""The scan is part of the stream's plan, run once by a micro-batch; a batch leaves few small files."""
import glob
import uuid

import pytest
from pyspark.sql import functions as F

from leakscan.plans import fixtures as FX
from leakscan.plans import stream_queries as SQ
from leakscan.session import scratch_path
from leakscan.sources import key_index as K
from leakscan.streaming import scan_stream as SS

LEAK, CLEAN = FX.TEMPLATES[16], "see you tomorrow at noon"


def local(path):
    return path.replace("file:", "")


def landed(spark, p, batches):
    """A file for each list of (chat, message, text, media)."""
    schema = SS.MESSAGE_SCHEMA.replace("TIMESTAMP", "STRING") + ", model_score DECIMAL(5,3)"
    for rows in batches:
        df = spark.createDataFrame([(c, m, t, media) for c, m, t, media in rows], "chat_id bigint, message_id bigint, text string, media boolean")
        cols = {x.split()[0]: x.split(maxsplit=1)[1] for x in ("date STRING", "sender_id BIGINT", "is_forward BOOLEAN", "out BOOLEAN", "model_score DECIMAL(5,3)")}
        sender = F.lit(None).cast("struct<id:bigint,username:string,first_name:string,last_name:string>")
        (df.select(*df.columns, *[F.lit(None).cast(t).alias(c) for c, t in cols.items()], sender.alias("sender"))
           .select("chat_id", "message_id", "date", "sender_id", "text", "is_forward", "out", "media", "sender", "model_score")
           .coalesce(1).write.mode("append").parquet(p["input"]))
    return SS.read_message_stream(spark, p["input"], max_files_per_trigger=1, schema=schema)


def run(spark, p, batches, sources=None, ocr=None):
    q = SS.start_scan_stream(landed(spark, p, batches), sources=sources, ocr=ocr, alerts_path=p["alerts"], dead_letter_path=p["dead"],
                             checkpoint_path=p["checkpoint"], trigger={"availableNow": True}, created_at=F.lit(FX.BATCH_TS).cast("timestamp"))
    q.awaitTermination()
    return q


def test_batches_do_not_plan_the_scan(spark, monkeypatch):
    built = []
    whole = SS.alert_candidates
    monkeypatch.setattr(SS, "alert_candidates", lambda *a, **k: built.append(1) or whole(*a, **k))
    before = spark.conf.get(SS.STREAM_AQE, None)
    p = SQ._paths(spark, "plan")
    first = [(3, 1, LEAK, False), (3, 2, CLEAN, False), (3, 1, LEAK, False), (4, 7, LEAK, False), (None, 5, LEAK, False), (3, None, CLEAN, None), (3, 8, CLEAN, True)]
    later = [(3, 1, LEAK, None), (3, 2, LEAK, False), (3, 9, CLEAN, True)]
    # the registry and the OCR table may repeat rows
    sources = spark.createDataFrame([(3,), (3,), (None,)], "chat_id bigint")
    ocr = spark.createDataFrame([(3, 8, LEAK), (3, 8, LEAK + " b"), (4, 9, LEAK)], "chat_id bigint, message_id bigint, ocr_text string")
    q = run(spark, p, [first, later, later], sources, ocr)
    assert len(built) == 1 and spark.conf.get(SS.STREAM_AQE, None) == before
    assert q.lastProgress["batchId"] == 2 and len(q.lastProgress["sources"]) == 1
    got = spark.read.parquet(p["alerts"]).select("chat_id", "message_id", "batch_id", "ocr_text").collect()
    assert sorted((r.chat_id, r.message_id) for r in got) == [(3, 1), (3, 2), (3, 8)]
    assert {r.batch_id for r in got} <= {0, 1, 2} and [r.ocr_text for r in got if r.message_id == 8 and r.ocr_text]
    dead = spark.read.parquet(p["dead"])
    assert sorted((r.chat_id or 0, r.message_id or 0, r.text) for r in dead.collect()) == [(0, 5, LEAK), (3, 0, CLEAN)]
    assert dead.columns[:10] == ["chat_id", "message_id", "date", "sender_id", "text", "is_forward", "out", "media", "sender", "model_score"]


def test_static_batch_leaves_what_the_stream_leaves(spark):
    rows = [(3, i, LEAK if i % 3 else CLEAN, False) for i in range(12)] + [(None, 1, LEAK, False)]
    p, s = SQ._paths(spark, "stream"), SQ._paths(spark, "static")
    run(spark, p, [rows])
    for _ in range(2):
        SS.process_batch(spark.read.schema(SQ.STREAM_SCHEMA).parquet(p["input"]), 0, sources=None, ocr=None, alerts_path=s["alerts"],
                         dead_letter_path=s["dead"], created_at=F.lit(FX.BATCH_TS).cast("timestamp"))
    for k in ("alerts", "dead"):
        a, b = ([str(r) for r in spark.read.parquet(x[k]).collect()] for x in (p, s))
        assert sorted(a) == sorted(b) and a


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"slices-{uuid.uuid4().hex}")


def keys(spark, lo, hi):
    return spark.range(lo, hi).select((F.col("id") % 3).alias("chat_id"), F.col("id").alias("message_id"))


def ids(df):
    return sorted(r.message_id for r in df.collect())


def test_keys_of_a_batch_are_one_file(spark, path):
    K.write_keys(keys(spark, 0, 2000), path, 0)
    K.write_keys(keys(spark, 0, 0), path, 1)
    assert len(glob.glob(local(path) + "/delta=0/**/*.parquet", recursive=True)) == 1
    assert not glob.glob(local(path) + "/delta=*/*=*")
    assert ids(K.without_known(keys(spark, 1990, 2010), path, 2)) == list(range(2000, 2010))


def test_many_keys_are_cut_and_only_hit_slices_read(spark, path, monkeypatch):
    monkeypatch.setattr(K, "SLICE_KEYS", 100)
    K.write_keys(keys(spark, 0, 1500), path, 0)
    monkeypatch.setattr(K, "SLICE_KEYS", 1 << 18)
    K.write_keys(keys(spark, 1500, 1510), path, 1)
    assert 8 <= len(glob.glob(local(path) + "/delta=0/slices=16/slice=*")) <= 16
    hit = [r[0] for r in keys(spark, 7, 8).select(K.bucket_of(*K.KEYS)).collect()]
    read = K._read(spark, [f"{path}/delta=0"], hit)
    assert len({f for r in read.select(F.input_file_name()).collect() for f in r}) == 1 and 7 in ids(read) and read.count() < 20
    assert ids(K.without_known(keys(spark, 1495, 1515), path, 2)) == list(range(1510, 1515))
    assert ids(K.without_known(keys(spark, 7, 8), path, 2)) == []


def test_folders_of_earlier_versions(spark, path):
    for kind, lo in (("base=3", 0), ("delta=4", 100)):
        keys(spark, lo, lo + 100).withColumn("bucket", K.bucket_of(*K.KEYS)).write.partitionBy("bucket").parquet(f"{path}/{kind}")
    K.write_keys(keys(spark, 200, 300), path, 5)
    assert ids(K.without_known(keys(spark, 95, 305), path, 6)) == list(range(300, 305))


def test_a_small_base_is_written_more_often(spark, path, monkeypatch):
    monkeypatch.setattr(K, "COMPACT_SMALL", 2)
    monkeypatch.setattr(K, "SLICE_KEYS", 25)
    for b in range(7):
        K.compact(spark, path, b)
        assert ids(K.without_known(keys(spark, 0, 10 * b + 5), path, b)) == list(range(10 * b, 10 * b + 5))
        K.write_keys(keys(spark, 10 * b, 10 * b + 10), path, b)
    # 20 keys are one file; 40 are cut, and such a base waits for COMPACT batches
    assert K._folders(spark, path, "base") == [3] and K._folders(spark, path, "delta") == [4, 5, 6]
