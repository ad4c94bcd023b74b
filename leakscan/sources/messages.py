"""Message-side sources (S1-S5): landed messenger exports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import message_text

MESSAGE_SCHEMA = ("chat_id BIGINT, message_id BIGINT, date STRING, sender_id BIGINT, text STRING, "
                  "is_forward BOOLEAN, out BOOLEAN, media BOOLEAN, "
                  "sender STRUCT<id:BIGINT,username:STRING,first_name:STRING,last_name:STRING>")


def read_messages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed export files with a declared schema (no inference)."""
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def ingest_messages(raw: DataFrame, max_chars: int | None = C.MESSAGE_TEXT_LIMIT) -> DataFrame:
    """Placeholder for null/empty text, optional cut (the messenger API
    delivers 500 + '...'; ``max_chars=None`` keeps whole texts), flags as
    booleans (null -> false), sender as given."""
    return raw.select(
        "chat_id", "message_id", "date", "sender_id",
        message_text(F.col("text"), max_chars).alias("text"),
        F.coalesce(F.col("is_forward"), F.lit(False)).alias("is_forward"),
        F.coalesce(F.col("out"), F.lit(False)).alias("out"),
        F.coalesce(F.col("media"), F.lit(False)).alias("media"),
        "sender")


def latest_n_per_chat(msgs: DataFrame, n: int = 10) -> DataFrame:
    """Newest n messages of every chat. Catalyst plans a
    WindowGroupLimit, so each task keeps only n rows per chat before the
    shuffle: a chat holding a third of all rows costs n rows per task."""
    w = Window.partitionBy("chat_id").orderBy(F.col("message_id").desc())
    return msgs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dialog_type(is_channel, is_group):
    return F.when(is_channel, "channel").when(is_group, "group").otherwise("user")


def list_dialogs(dialogs: DataFrame, n: int = 10) -> DataFrame:
    """S3: first n dialogs; title falls back to name, then a fixed label."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")),
                       F.when(F.col("name") != "", F.col("name")), F.lit(C.NO_TITLE))
    return (dialogs.select(
        "id", "entity_id", title.alias("title"),
        dialog_type(F.coalesce(F.col("is_channel"), F.lit(False)), F.coalesce(F.col("is_group"), F.lit(False))).alias("type"),
        "username",
        F.coalesce(F.col("unread_count"), F.lit(0)).alias("unread_count"),
        F.coalesce(F.col("unread_mentions"), F.lit(0)).alias("unread_mentions"))
        .orderBy("id").limit(n))


def chat_info(chats: DataFrame, chat_id: int) -> DataFrame:
    """One chat by id (the predicate reaches the parquet scan)."""
    t = F.when(F.coalesce(F.col("broadcast"), F.lit(False)), "channel") \
        .when(F.coalesce(F.col("megagroup"), F.lit(False)), "group").otherwise("user")
    return chats.where(F.col("id") == chat_id).select("id", "title", "username", t.alias("type"))


def attachment_bytes(msgs: DataFrame, attachments: DataFrame) -> DataFrame:
    """The photo bytes of media messages; under 100 bytes -> null."""
    a = attachments.select("chat_id", "message_id", "content")
    return (msgs.where(F.col("media")).select("chat_id", "message_id")
                .join(a, ["chat_id", "message_id"], "left")
                .select("chat_id", "message_id",
                        F.when(F.octet_length("content") >= C.MIN_ATTACHMENT_BYTES, F.col("content")).alias("content")))


def read_binary_files(spark, path: str, glob: str = "*") -> DataFrame:
    """Attachment files landed on storage: path, length and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
