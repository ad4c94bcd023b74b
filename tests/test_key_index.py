"""R2: the key index is exact, reads the buckets that are hit, and compacts."""
import uuid

import pytest
from pyspark.sql import functions as F

from leakscan.session import scratch_path
from leakscan.sources import key_index as K


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"keys-{uuid.uuid4().hex}")


def keys(spark, lo, hi):
    return spark.range(lo, hi).select((F.col("id") % 3).alias("chat_id"), F.col("id").alias("message_id"))


def ids(df):
    return sorted(r.message_id for r in df.collect())


def test_earlier_batches_only(spark, path):
    assert not K.known(spark, path, 5) and ids(K.without_known(keys(spark, 0, 5), path, 0)) == [0, 1, 2, 3, 4]
    K.write_keys(keys(spark, 0, 10), path, 0)
    K.write_keys(keys(spark, 10, 20), path, 1)
    assert ids(K.without_known(keys(spark, 5, 25), path, 2)) == [20, 21, 22, 23, 24]
    # a replay of batch 1 doesn't see its own keys
    assert ids(K.without_known(keys(spark, 5, 25), path, 1)) == list(range(10, 25))
    K.write_keys(keys(spark, 10, 12), path, 1)
    assert ids(K.without_known(keys(spark, 5, 25), path, 2)) == list(range(12, 25))


def test_only_hit_buckets_are_read(spark, path):
    K.write_keys(keys(spark, 0, 3000), path, 0)
    plan = K.without_known(keys(spark, 7, 8), path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    df = K._read(spark, [f"{path}/delta=0"], [r[0] for r in keys(spark, 7, 8).select(K.bucket_of(*K.KEYS)).collect()])
    assert 1 <= df.count() < 40


def test_compaction_keeps_all_keys(spark, path, monkeypatch):
    monkeypatch.setattr(K, "COMPACT", 3)
    for b in range(8):
        K.compact(spark, path, b)
        assert ids(K.without_known(keys(spark, 0, 10 * b + 5), path, b)) == list(range(10 * b, 10 * b + 5))
        K.write_keys(keys(spark, 10 * b, 10 * b + 10), path, b)
        folders, base = K._parts(spark, path, b + 1)
        assert len(folders) <= 4
    assert K._folders(spark, path, "base") == [5]
    assert min(K._folders(spark, path, "delta")) == 6


def test_unfinished_base_is_ignored(spark, path):
    K.write_keys(keys(spark, 0, 10), path, 0)
    keys(spark, 0, 1).withColumn("bucket", F.lit(0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/base=0")
    assert K._folders(spark, path, "base") == []
    assert ids(K.without_known(keys(spark, 0, 12), path, 1)) == [10, 11]


def test_index_of_an_older_table(spark, path):
    K.ensure(spark, path, 4, keys(spark, 0, 10))
    assert ids(K.without_known(keys(spark, 0, 12), path, 4)) == [10, 11]
    K.ensure(spark, path, 5, keys(spark, 0, 100))      # there is one already
    assert ids(K.without_known(keys(spark, 0, 12), path, 5)) == [10, 11]
