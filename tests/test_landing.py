"""Layout of landed messages: row groups by bytes, scans with as many tasks as the data allows."""
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_CHECK
from leakscan.plans import fixtures as FX
from leakscan.session import scratch_path
from leakscan.sources import landing as L


def groups(path):
    files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(path.replace("file:", "") + "/*.parquet"))]
    return [m.row_group(i) for m in files for i in range(m.num_row_groups)]


def test_groups_are_cut_by_bytes_and_rows_stay(spark):
    m = FX.msgs(spark, SF_CHECK)
    path = scratch_path(spark, "landing-test")
    L.land_messages(m, path, mode="overwrite", group_bytes=256 << 10)
    size = m.agg(F.sum(F.octet_length("text"))).first()[0]
    got = groups(path)
    assert len(got) >= size // (4 * (256 << 10))
    assert all(g.total_byte_size < 3 * (256 << 10) or g.num_rows <= 2 * L.CHECK_ROWS for g in got)
    back = L.read_landed(spark, path, m.schema)
    assert back.exceptAll(m).isEmpty() and m.exceptAll(back).isEmpty()


def test_one_input_task_lands_for_many_scan_tasks(spark):
    rows = spark.range(400).coalesce(1).select(F.col("id").alias("message_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 400).alias("text"))
    path = scratch_path(spark, "landing-one")
    L.land_messages(rows, path, mode="overwrite")
    assert len(glob.glob(path.replace("file:", "") + "/*.parquet")) == 1
    assert len(groups(path)) >= 8


def test_texts_longer_than_a_group_and_null_texts(spark):
    rows = spark.createDataFrame([(k, "x y " * 200_000 if k % 9 == 0 else (None if k % 2 else "")) for k in range(40)], "message_id bigint, text string")
    path = scratch_path(spark, "landing-long")
    L.land_messages(rows, path, mode="overwrite", group_bytes=1 << 10)
    back = L.read_landed(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
