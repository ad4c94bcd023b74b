"""A chat holding a third of all messages: results stay right and the plans
keep the shapes that bound per-task work (limit before the shuffle, partial
aggregation, scan not partitioned by chat)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leakscan.operators.alerts import messages_count
from leakscan.operators.analyze import scan_and_score
from leakscan.plans import fixtures as FX
from leakscan.sources.messages import latest_n_per_chat


def hot(spark):
    m = FX.msgs(spark, SF_SMALL)
    return m.withColumn("chat_id", F.when(F.col("message_id") % 3 == 0, F.lit(0)).otherwise(F.col("chat_id")))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_n_under_skew(spark):
    m = hot(spark)
    out = latest_n_per_chat(m, 10)
    p = physical(out)
    assert "WindowGroupLimit" in p
    got = sorted(r.message_id for r in out.where("chat_id = 0").collect())
    want = sorted(r.message_id for r in m.where("chat_id = 0").orderBy(F.desc("message_id")).limit(10).collect())
    assert got == want


def test_counts_under_skew(spark):
    m = hot(spark)
    out = messages_count(m)
    p = physical(out)
    assert p.count("HashAggregate") >= 2  # partial + final
    total = m.count()
    hot_n = out.where("chat_id = 0").first()["messages_count"]
    assert hot_n == m.where("chat_id = 0").count() and hot_n >= total / 3


def test_scan_is_not_partitioned_by_chat(spark):
    m = hot(spark)
    p = physical(scan_and_score(m))
    assert "hashpartitioning(chat_id" not in p.replace(" ", "") or "message_id" in p
    assert "Window" not in p and "Aggregate" not in p
