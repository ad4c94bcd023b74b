"""Plan shape: pushdown, pruning, top-k, window limit, no multiplied scans."""
import time

import __spark_entry__ as E
from conftest import SF_SMALL
from leakscan.catalog import DETECTORS


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chat_info_predicate_reaches_parquet(spark):
    p = physical(E.queries()["chat_info"](spark, SF_SMALL))
    assert "PushedFilters" in p and "EqualTo(c_custkey,42)" in p


def test_column_pruning(spark):
    p = physical(E.queries()["text_length"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_one_regex_pass_per_detector(spark):
    p = optimized(E.queries()["scan_score"](spark, SF_SMALL))
    # one marking pass + one Unicode strip per detector, plus the blank test
    assert p.count("regexp_replace(") <= 2 * len(DETECTORS) + 2


def marking_passes(plan: str) -> int:
    """Detector passes in a plan: each marks its matches once; D27 marks its braces and its dashes."""
    return plan.count("$0") - 1


def test_alert_rows_do_not_rescan(spark):
    for name in ("build_alerts", "alerts_response", "analyze_messages"):
        p = optimized(E.queries()[name](spark, SF_SMALL))
        assert marking_passes(p) == len(DETECTORS), name
        assert not any("Filter" in ln and "regexp_replace" in ln for ln in p.splitlines()), name


def test_filtered_analysis_plans_in_seconds(spark):
    """Predicates, projections and aggregates on analysed messages don't multiply the scan."""
    a = E.queries()["analyze_messages"](spark, SF_SMALL)
    for df in (a.where("alert AND model_score = 0"), a.where("sx_score > 0.3 OR n_kept > 2").select("message_id"),
               a.groupBy("alert").count(), a.where("has_ocr").orderBy("sx_score").limit(5)):
        t = time.time()
        p = optimized(df)
        assert time.time() - t < 20
        assert marking_passes(p) == len(DETECTORS)


def test_explode_does_not_copy_scan(spark):
    for name in ("scan_all", "dedup_findings", "min_length_filter", "detect_email"):
        p = optimized(E.queries()[name](spark, SF_SMALL))
        assert p.count("regexp_replace(") <= 2 * len(DETECTORS) + 2, name


def test_top_k_and_window_limit(spark):
    assert "TakeOrderedAndProject" in physical(E.queries()["recent_alerts"](spark, SF_SMALL))
    assert "WindowGroupLimit" in physical(E.queries()["latest_n_per_chat"](spark, SF_SMALL))


def test_scan_has_no_shuffle_of_its_own(spark):
    from leakscan.operators.analyze import scan_and_score
    from leakscan.plans import fixtures as FX
    d = FX.table(spark, SF_SMALL, "documents").select("doc_id", "text").repartition(16)
    p = physical(scan_and_score(d, model_col=None))
    assert p.count("Exchange") == 1  # only the test's own repartition


def test_messages_of_a1_are_scanned_in_a_stated_number_of_partitions(spark):
    """Left to adaptive execution, the scan after the key join gets a task a core or less."""
    from leakscan.operators.alerts import analyze_messages
    from leakscan.plans import fixtures as FX
    m = FX.msgs(spark, SF_SMALL)
    p = physical(analyze_messages(m, None, FX.processed_keys(spark, SF_SMALL)).select("chat_id", "alert"))
    assert "REPARTITION_BY_NUM" in p


def test_alerts_of_a_month_are_one_file(spark, tmp_path):
    """A file for each month and writer grew with both."""
    from leakscan.plans.fixtures import alert_created_at
    from leakscan.sources.alert_store import read_alerts, write_alerts
    from pyspark.sql import functions as F
    rows = spark.range(6000).select((F.col("id") % 9).alias("chat_id"), F.col("id").alias("message_id"))
    rows = rows.select("*", alert_created_at().alias("created_at"))
    rows = rows.select("*", F.lit(0.7).alias("sx_score"), F.lit(0.1).alias("model_score"), F.lit("t").alias("text_preview"),
                       F.lit("[]").alias("leaks"), F.lit("").alias("ocr_text"), F.lit("{}").alias("sender"), F.col("created_at").alias("date"))
    path = str(tmp_path / "alerts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_alerts(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(len(list(month.glob("*.parquet"))) == 1 for month in (tmp_path / "alerts").glob("month=*"))
    back = read_alerts(spark, path)
    assert back.count() == 6000 and back.select("message_id").distinct().count() == 6000
