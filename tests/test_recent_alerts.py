"""The newest rows are read from the newest months alone."""
import uuid

import pytest
from pyspark.sql import functions as F

from leakscan.session import scratch_path
from leakscan.sources import alert_store as A


@pytest.fixture(scope="module")
def table(spark):
    path = scratch_path(spark, f"recent-{uuid.uuid4().hex}")
    rows = spark.range(400).select(
        (F.col("id") % 7).alias("chat_id"), F.col("id").alias("message_id"), F.lit(0.5).alias("sx_score"), F.lit(0.0).alias("model_score"),
        F.lit("t").alias("text_preview"), F.lit("[]").alias("leaks"), F.lit("").alias("ocr_text"), F.lit("{}").alias("sender"),
        F.lit(None).cast("timestamp").alias("date"),
        F.when(F.col("id") % 50 != 49, F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp"))).alias("created_at"))
    A.write_alerts(rows, path)
    return A.read_alerts(spark, path)


def order(df):
    return df.orderBy(F.col("created_at").desc(), "chat_id", "message_id")


def months_read(df):
    return {f.split("month=")[1].split("/")[0] for f in df.inputFiles()}


@pytest.mark.parametrize("n", [1, 4, 40, 300, 395, 1000])
def test_equal_to_a_full_sort(table, n):
    want = [r.message_id for r in order(table).limit(n).collect()]
    assert [r.message_id for r in A.recent_alerts(table, n).collect()] == want


def test_one_month_is_read_where_it_holds_enough(table):
    months = A.newest_months(table, 3)
    assert months == [202402]
    plan = A.recent_alerts(table, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "202402" in plan and "202401" not in plan
    assert len(A.newest_months(table, 10**6)) == 15 and A.newest_months(table, 10**6)[-1] is None


@pytest.mark.parametrize("chats", [[], [3], [0, 1, 2, 3, 4, 5, 6], [99]])
def test_by_source(spark, table, chats):
    src = spark.createDataFrame([(c,) for c in chats], "chat_id bigint")
    want = [r.message_id for r in order(table.where(F.col("chat_id").isin(chats))).limit(10).collect()]
    assert [r.message_id for r in A.recent_alerts_by_source(table, src, 10).collect()] == want


def test_counts_read_no_column(table):
    plan = table.groupBy("month").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
