"""Derived inputs built by Spark from the driver tables (FIXTURES.md §2).

The driver tables hold no chat messages, so the message-shaped inputs
are derived deterministically from ``documents``/``labels``/``customer``/
``conversations``/``events``. Texts are never cut: a leak template is put
in front of the whole document text.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Leak templates put in front of document texts, by doc_id % TEMPLATE_CYCLE (the rest: none)
TEMPLATE_CYCLE = 24
TEMPLATES = [
    "write to bob@corp.example.org today",
    "write to bob@mail.ru today",
    "router 192.168.1.1 and 192.168.5.10 wifi",
    "x login=bob; password='s3cretpw'",
    "ping +7(916)123-45-67 now",
    "token eyJhbGciOi.eyJzdWIi.abc-_1 bearer",
    "set api_key='ABCDEFGHIJKLMNOPQRSTUVWX'",
    "данные: паспорт 4510 123456 сотрудника",
    "мой СНИЛС 112-233-445 95",
    "тел. Петров Пётр Петрович 89161234567",
    "seed: apple apple apple apple apple apple apple apple apple apple apple apple",
    "пришли фото паспорта сотрудника",
    "сумма 500100732259 руб",
    "живу ул. Ленина, д. 5, кв. 7;",
    "born 12.05.1990 ok",
    "user pass hunter22 ok",
    "Паспорт 4510 123456 сотрудника Иванов Иван Иванович, тел +7(916)123-45-67 мой логин: vasya пароль: qwerty123",
    "наш иванов иван иванович дома;",
    "вот Иванов Иван Иванович - паспорт у него",
    "xx -----BEGIN RSA PRIVATE KEY-----\nAB\n-----END RSA PRIVATE KEY-----",
    "- user: root",
    "cfg {db_password: 'x'} end",
]
BASE_TS = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _template_col(doc_id):
    k = doc_id % TEMPLATE_CYCLE
    expr = None
    for i, t in enumerate(TEMPLATES):
        expr = F.when(k == i, F.lit(t)) if expr is None else expr.when(k == i, F.lit(t))
    return expr


def _iso_date(doc_id):
    ts = F.timestamp_add("MINUTE", doc_id, F.lit(BASE_TS).cast("timestamp"))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    k = doc_id % 4
    return (F.when(k == 0, F.concat(base, F.lit("+00:00")))
            .when(k == 1, F.concat(base, F.lit(".123+03:00")))
            .when(k == 2, F.concat(base, F.lit("Z"))))


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows (schema of the messenger export) with a model score.

    ``labels`` is joined by key; at scale this is a shuffle join on
    ``doc_id`` (AQE may turn it into a broadcast when labels are small).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    doc_id = F.col("doc_id")
    tmpl = _template_col(doc_id)
    text = F.when(tmpl.isNull(), F.col("text")).otherwise(F.concat(tmpl, F.lit(" "), F.coalesce(F.col("text"), F.lit(""))))
    sender_id = (F.lit(1000) + doc_id % 50).cast("bigint")
    sender = F.when(doc_id % 5 == 0, F.lit(None)).otherwise(F.struct(
        sender_id.alias("id"),
        F.when(doc_id % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("user"), sender_id.cast("string"))).alias("username"),
        F.concat(F.lit("Name"), (doc_id % 10).cast("string")).alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
    ))
    return (d.join(lab, "doc_id", "left")
             .select(
                 F.substring(F.col("source"), 4, 12).cast("bigint").alias("chat_id"),
                 doc_id.cast("bigint").alias("message_id"),
                 _iso_date(doc_id).alias("date"),
                 sender_id.alias("sender_id"),
                 text.alias("text"),
                 (doc_id % 6 == 0).alias("is_forward"),
                 (doc_id % 8 == 0).alias("out"),
                 (doc_id % 7 == 0).alias("media"),
                 sender.alias("sender"),
                 (F.coalesce(F.col("toxic"), F.lit(0)).cast("decimal(5,3)") * F.lit(Decimal("0.9"))).cast("decimal(5,3)").alias("model_score"),
             ))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered sources: chats with chat_id % 3 = 0."""
    m = msgs(spark, sf_dir).select("chat_id").distinct().where(F.col("chat_id") % 3 == 0)
    return m.select(
        "chat_id",
        F.concat(F.lit("chat "), F.col("chat_id").cast("string")).alias("title"),
        F.lit("group").alias("type"),
        F.timestamp_add("HOUR", F.col("chat_id"), F.lit(BASE_TS).cast("timestamp")).alias("added_at"),
    )


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("bigint").alias("id"),
        (k + 1000000).cast("bigint").alias("entity_id"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.col("c_name")).alias("title"),
        F.when(k % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("name"),
        (k % 3 == 0).alias("is_channel"),
        (k % 3 == 1).alias("is_group"),
        F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("username"),
        F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((k % 17).cast("int")).alias("unread_count"),
        F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((k % 5).cast("int")).alias("unread_mentions"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("bigint").alias("id"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("title"),
        F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("username"),
        (k % 3 == 0).alias("broadcast"),
        (k % 3 == 1).alias("megagroup"),
    )


def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OCR read per (image, variant, parameter set); image = conv_id."""
    c = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    return c.select(
        conv.cast("bigint").alias("image_id"),
        (F.col("turn") / 4).cast("int").alias("variant_no"),
        (F.col("turn") % 4).cast("int").alias("param_no"),
        F.lit(640).alias("width"),
        F.when(conv % 9 == 0, F.lit(40)).otherwise(F.lit(480)).alias("height"),
        F.when(conv % 13 == 0, F.lit("   ")).otherwise(F.col("text")).alias("text"),
    )


def ocr_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback read without preprocessing: the turn-0 text, absent when conv_id % 5 = 0."""
    c = table(spark, sf_dir, "conversations")
    return (c.where((F.col("turn") == 0) & (F.col("conv_id") % 5 != 0))
             .select(F.col("conv_id").cast("bigint").alias("image_id"), F.col("text")))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image list: every conversation id is one attached image."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("bigint").alias("image_id")).distinct()


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment bytes of media messages: the UTF-8 bytes of the image's
    turn-0 conversation text (image id = message id), keyed by chat and message."""
    c = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    c = c.select(F.col("conv_id").cast("bigint").alias("message_id"),
                 F.encode(F.col("text"), "UTF-8").alias("content"))
    return msgs(spark, sf_dir).select("chat_id", "message_id").join(c, "message_id").select("chat_id", "message_id", "content")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty labelled texts: label is text, 'x' / '2' / null in places."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    k = F.col("doc_id")
    label = (F.when(k % 17 == 0, F.lit("x")).when(k % 19 == 0, F.lit("2"))
             .otherwise(F.col("toxic").cast("string")))
    return d.join(lab, "doc_id", "left").select(
        k.cast("bigint").alias("id"), F.col("text"), label.alias("label"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("comment"))


def source_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry operations from ``events``: signup = upsert, error = delete."""
    e = table(spark, sf_dir, "events")
    return (e.where(F.col("event_type").isin("signup", "error"))
             .select(F.col("user_id").cast("bigint").alias("chat_id"),
                     F.when(F.col("event_type") == "signup", F.lit("upsert")).otherwise(F.lit("delete")).alias("op"),
                     F.concat(F.col("event_type"), F.col("event_id").cast("string")).alias("title"),
                     F.lit("group").alias("type"),
                     F.col("ts"), F.col("event_id").cast("bigint").alias("seq")))


def processed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore batches of processed keys from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("bigint").alias("chat_id"),
                    (F.col("event_id") % 50).cast("bigint").alias("message_id"),
                    F.col("ts").alias("processed_at"), F.col("event_id").cast("bigint").alias("seq"))


_LANDED: dict = {}


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a scan reads them: landed once per session and sf below the shared
    checkpoint folder, in row groups of a fixed number of bytes."""
    import uuid
    from ..session import scratch_path
    from ..sources.landing import land_messages, read_landed
    m = msgs(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _LANDED:
        path = scratch_path(spark, f"landed-{uuid.uuid4().hex}")
        land_messages(m, path)
        _LANDED[key] = path
    return read_landed(spark, _LANDED[key], m.schema)


# --- composed inputs of the alert flow -----------------------------------------
ALERT_DAY0 = "2024-01-20 00:00:00"
BATCH_TS = "2024-03-01 00:00:00"


def processed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages already alerted before this run: message_id % 11 = 0."""
    return msgs(spark, sf_dir).where(F.col("message_id") % 11 == 0).select("chat_id", "message_id")


def ocr_for_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR text of every media message whose attachment has >= 100 bytes."""
    from ..operators.ocr import best_ocr_text
    from ..sources.messages import attachment_bytes
    m = msgs(spark, sf_dir)
    att = attachment_bytes(m, attachments(spark, sf_dir)).where(F.col("content").isNotNull())
    imgs = att.select(F.col("message_id").alias("image_id"))
    best = best_ocr_text(imgs, ocr_candidates(spark, sf_dir), ocr_base(spark, sf_dir))
    # an image is named by its message id alone here; the chat comes from the message
    return att.select("chat_id", "message_id").join(best, F.col("image_id") == F.col("message_id")).select("chat_id", "message_id", "ocr_text")


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.alerts import analyze_messages
    return analyze_messages(landed(spark, sf_dir), ocr_for_messages(spark, sf_dir),
                            processed_keys(spark, sf_dir))


def alert_created_at():
    """One poll per 50 message ids, one day apart (spans month partitions)."""
    return F.timestamp_add("DAY", (F.col("message_id") / 50).cast("int"), F.lit(ALERT_DAY0).cast("timestamp"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.alerts import alert_candidates, build_alerts
    cands = alert_candidates(landed(spark, sf_dir), ocr_for_messages(spark, sf_dir), processed_keys(spark, sf_dir))
    return build_alerts(cands, alert_created_at())


_ALERT_TABLES: dict = {}


def alerts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table as the reports read it: built once per session and
    sf, written month-partitioned (S12) below the shared checkpoint folder,
    then read back. Later report queries read the table, not the scan."""
    import uuid
    from ..session import scratch_path
    from ..sources.alert_store import read_alerts, write_alerts
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _ALERT_TABLES.get(key)
    if path is None:
        path = scratch_path(spark, f"alerts-{uuid.uuid4().hex}")
        write_alerts(alerts(spark, sf_dir), path, mode="overwrite")
        _ALERT_TABLES[key] = path
    return read_alerts(spark, path)
