"""Source registry and processed-message set (S7-S11) as table algebra.

The registry and the processed set are tables; every operation is a
relational step (window dedup, anti/semi/existence join) that a table
format's MERGE could replace one to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_sources(existing: DataFrame, ops: DataFrame) -> DataFrame:
    """S7 + S8 replayed in order: for each chat_id the last operation by
    (ts, seq) decides; upsert keeps (title, type, added_at=ts), delete drops.

    ``existing``: chat_id, title, type, added_at. ``ops``: chat_id, op
    ('upsert'/'delete'), title, type, ts, seq. One hash aggregate on
    chat_id with map-side partial ``max_by``: a hot key is combined per
    task before the shuffle.
    """
    cur = existing.select("chat_id", "title", "type", F.col("added_at").alias("ts"),
                          F.lit("upsert").alias("op"), F.lit(-1).cast("bigint").alias("seq"))
    new = ops.select("chat_id", "title", "type", "ts", "op", "seq")
    both = cur.unionByName(new)
    last = both.groupBy("chat_id").agg(F.max_by(F.struct("op", "title", "type", "ts"),
                                                F.struct("ts", "seq")).alias("l"))
    return last.where(F.col("l.op") == "upsert").select(
        "chat_id", F.col("l.title").alias("title"), F.col("l.type").alias("type"), F.col("l.ts").alias("added_at"))


def remove_sources(existing: DataFrame, chat_ids: DataFrame) -> DataFrame:
    """Delete by key (left anti join)."""
    return existing.join(chat_ids.select("chat_id").distinct(), "chat_id", "left_anti")


def list_sources(sources: DataFrame) -> DataFrame:
    """All sources, newest first (chat_id breaks ties)."""
    return sources.orderBy(F.col("added_at").desc(), F.col("chat_id"))


def with_processed_flag(msgs: DataFrame, processed: DataFrame) -> DataFrame:
    """Existence join: adds ``is_processed``."""
    keys = processed.select("chat_id", "message_id").distinct().withColumn("_p", F.lit(True))
    return msgs.join(keys, ["chat_id", "message_id"], "left") \
        .withColumn("is_processed", F.coalesce(F.col("_p"), F.lit(False))).drop("_p")


def mark_processed(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert-or-ignore: the first ``processed_at`` of a key stays.
    ``batch`` may repeat keys; the earliest (processed_at, seq) wins
    (partial ``min`` per task, then one shuffle on the key)."""
    ex = existing.select("chat_id", "message_id", "processed_at")
    first = (batch.groupBy("chat_id", "message_id")
                  .agg(F.min(F.struct("processed_at", "seq")).alias("f"))
                  .select("chat_id", "message_id", F.col("f.processed_at").alias("processed_at")))
    fresh = first.join(ex.select("chat_id", "message_id"), ["chat_id", "message_id"], "left_anti")
    return ex.unionByName(fresh)
