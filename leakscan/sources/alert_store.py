"""Alert table (S12-S14): month-partitioned parquet, newest-first reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaks_from_json, sender_from_json

ALERT_COLUMNS = ["chat_id", "message_id", "sx_score", "model_score", "text_preview", "leaks",
                 "ocr_text", "sender", "date", "created_at"]


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """``month`` = yyyyMM of ``created_at`` is the partition column;
    rows are clustered by (created_at, chat_id) inside each file so a
    time-range read skips row groups. Scores are stored as FLOAT."""
    out = (alerts.select(
        F.col("chat_id").cast("bigint"), F.col("message_id").cast("bigint"),
        F.col("sx_score").cast("float"), F.col("model_score").cast("float"),
        "text_preview", "leaks", "ocr_text", "sender",
        F.date_trunc("millisecond", F.col("date")).alias("date"),
        F.date_trunc("millisecond", F.col("created_at")).alias("created_at"))
        .withColumn("month", F.date_format("created_at", "yyyyMM")))
    # one writer a month (a month for each of the writers gave a file, growing with both): adaptive execution
    # joins small months in one task and spreads a month beyond its advisory size over several. A range
    # partitioning would need a sampling pass, i.e. a second evaluation of the whole scan.
    (out.hint("rebalance", "month").sortWithinPartitions("month", "created_at", "chat_id")
        .write.mode(mode).partitionBy("month").parquet(path))


def read_alerts(spark, path: str, since_month: str | None = None) -> DataFrame:
    """Alerts table; ``since_month`` prunes partitions."""
    df = spark.read.parquet(path)
    if since_month:
        df = df.where(F.col("month") >= since_month)
    return df


def decode_alerts(alerts: DataFrame) -> DataFrame:
    """JSON columns decoded, FLOAT scores widened to DOUBLE."""
    return alerts.select(
        "chat_id", "message_id",
        F.col("sx_score").cast("double").alias("sx_score"),
        F.col("model_score").cast("double").alias("model_score"),
        "text_preview", leaks_from_json(F.col("leaks")).alias("leaks"), "ocr_text",
        sender_from_json(F.col("sender")).alias("sender"), "date", "created_at")


def newest_months(alerts: DataFrame, n: int, kept=None) -> list:
    """The newest months that hold ``n`` alerts together (all months, if there are less).

    Rows per month come from the files' footers: no column is read. ``kept`` (a function of
    DataFrames) keeps some of the rows; then the rows it keeps are counted on the newest month, the next two,
    the next four, and so on, until there are ``n``."""
    counts = {r["month"]: r["count"] for r in alerts.groupBy("month").count().collect()}
    # alerts without a time come last
    left = sorted(counts, key=lambda m: (m is not None, m or 0), reverse=True)
    chosen, found, step = [], 0, 1
    while left and found < n:
        part, left = left[:step], left[step:]
        chosen += part
        if kept is None:
            found += sum(counts[m] for m in part)
        else:
            found += kept(_of_months(alerts, part)).count()
            step *= 2
    return chosen


def _of_months(alerts: DataFrame, months: list) -> DataFrame:
    here = F.col("month").isin([m for m in months if m is not None])
    return alerts.where(here | F.col("month").isNull() if None in months else here)


def _newest(alerts: DataFrame, n: int) -> DataFrame:
    return decode_alerts(alerts.orderBy(F.col("created_at").desc(), "chat_id", "message_id").limit(n))


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Newest n (TakeOrderedAndProject: each task keeps n rows). Of a table by month only the
    newest months that hold n rows are read."""
    if "month" in alerts.columns:
        alerts = _of_months(alerts, newest_months(alerts, n))
    return _newest(alerts, n)


def recent_alerts_by_source(alerts: DataFrame, sources: DataFrame, n: int = 50) -> DataFrame:
    """As S13 but only chats in the registry; an empty registry gives
    no rows. The registry is a small dimension: a left-semi join that
    Spark broadcasts when it is under the broadcast threshold."""
    chats = sources.select("chat_id").distinct()

    def kept(df):
        return df.join(chats, "chat_id", "left_semi")

    if "month" in alerts.columns:
        alerts = _of_months(alerts, newest_months(alerts, n, kept))
    return _newest(kept(alerts), n)
