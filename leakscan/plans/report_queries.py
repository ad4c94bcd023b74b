"""Registered queries for sources (S*), text/date operators (X*) and the
alert flow and reports (A*), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as T
from ..operators import alerts as A
from ..operators.ocr import best_ocr_text, gate_candidates, score_candidates
from ..sources import alert_store as S
from ..sources import messages as SM
from ..sources import registry as R
from . import fixtures as FX
from . import oracle as O
from .queries import REGISTRY

ORACLES: dict = {}


def reg(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def ts_str(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# --- S1-S5 --------------------------------------------------------------------
def _raw_messages(spark, sf):
    m = FX.msgs(spark, sf)
    k = F.col("message_id") % 9
    return m.withColumn("text", F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).otherwise(F.col("text")))


_RAW_MSGS_SQL = f"""raw AS (SELECT * REPLACE (CASE WHEN message_id % 9 = 0 THEN NULL WHEN message_id % 9 = 1 THEN ''
                                                ELSE text END AS text) FROM ({O.msgs_sql()}) m)"""


@reg("ingest_messages", f"""
WITH {_RAW_MSGS_SQL}
SELECT chat_id, message_id, date, sender_id,
       {O.cut_sql("CASE WHEN text IS NULL OR text = '' THEN '[media or empty]' ELSE text END", 500)} AS text,
       is_forward, "out", media, coalesce(to_json(sender), '{{}}') AS sender
FROM raw""")
def q_ingest(spark, sf):
    """S1 with the messenger API's 500-character delivery cut (its feature)."""
    df = SM.ingest_messages(_raw_messages(spark, sf), max_chars=C.MESSAGE_TEXT_LIMIT)
    return df.select("chat_id", "message_id", "date", "sender_id", "text", "is_forward", "out", "media",
                     T.sender_to_json(F.col("sender")).alias("sender"))


@reg("latest_n_per_chat", f"""
SELECT chat_id, message_id, date FROM (
  SELECT chat_id, message_id, date, row_number() OVER (PARTITION BY chat_id ORDER BY message_id DESC) AS rn
  FROM ({O.msgs_sql()}) m) t WHERE rn <= 10""")
def q_latest(spark, sf):
    return SM.latest_n_per_chat(FX.msgs(spark, sf), 10).select("chat_id", "message_id", "date")


_DIALOGS_SQL = """
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey + 1000000 AS BIGINT) AS entity_id,
       CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS title,
       CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_mktsegment END AS name,
       c_custkey % 3 = 0 AS is_channel, c_custkey % 3 = 1 AS is_group,
       CASE WHEN c_custkey % 2 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) END AS username,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 17 AS INTEGER) END AS unread_count,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INTEGER) END AS unread_mentions
FROM customer"""


@reg("list_dialogs", f"""
SELECT id, entity_id, coalesce(nullif(title, ''), nullif(name, ''), '{C.NO_TITLE}') AS title,
       CASE WHEN is_channel THEN 'channel' WHEN is_group THEN 'group' ELSE 'user' END AS type,
       username, coalesce(unread_count, 0) AS unread_count, coalesce(unread_mentions, 0) AS unread_mentions
FROM ({_DIALOGS_SQL}) d ORDER BY id LIMIT 10""")
def q_dialogs(spark, sf):
    return SM.list_dialogs(FX.dialogs(spark, sf), 10)


@reg("chat_info", """
SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS title,
       CASE WHEN c_custkey % 2 = 0 THEN 'u' || CAST(c_custkey AS VARCHAR) END AS username,
       CASE WHEN c_custkey % 3 = 0 THEN 'channel' WHEN c_custkey % 3 = 1 THEN 'group' ELSE 'user' END AS type
FROM customer WHERE c_custkey = 42""")
def q_chat_info(spark, sf):
    return SM.chat_info(FX.chats(spark, sf), 42)


@reg("attachment_scan", f"""
WITH msgs AS ({O.msgs_sql()}),
att AS (SELECT CAST(conv_id AS BIGINT) AS message_id, encode(text) AS content FROM conversations WHERE turn = 0)
SELECT m.chat_id, m.message_id,
       CAST(CASE WHEN octet_length(a.content) >= 100 THEN octet_length(a.content) END AS BIGINT) AS n_bytes
FROM msgs m LEFT JOIN att a ON a.message_id = m.message_id WHERE m.media""")
def q_attachments(spark, sf):
    df = SM.attachment_bytes(FX.msgs(spark, sf), FX.attachments(spark, sf))
    return df.select("chat_id", "message_id", F.octet_length("content").cast("bigint").alias("n_bytes"))


# --- S7-S14 -------------------------------------------------------------------
_SOURCES_SQL = f"""
SELECT DISTINCT chat_id, 'chat ' || CAST(chat_id AS VARCHAR) AS title, 'group' AS type,
       TIMESTAMP '{FX.BASE_TS}' + chat_id * INTERVAL 1 HOUR AS added_at
FROM ({O.msgs_sql()}) m WHERE chat_id % 3 = 0"""
_OPS_SQL = """
SELECT CAST(user_id AS BIGINT) AS chat_id, CASE WHEN event_type = 'signup' THEN 'upsert' ELSE 'delete' END AS op,
       event_type || CAST(event_id AS VARCHAR) AS title, 'group' AS type, ts, CAST(event_id AS BIGINT) AS seq
FROM events WHERE event_type IN ('signup', 'error')"""


@reg("upsert_source", f"""
WITH cur AS (SELECT chat_id, title, type, added_at AS ts, 'upsert' AS op, CAST(-1 AS BIGINT) AS seq FROM ({_SOURCES_SQL}) s),
ops AS ({_OPS_SQL}),
u AS (SELECT * FROM cur UNION ALL SELECT chat_id, title, type, ts, op, seq FROM ops),
l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, seq DESC) AS rn FROM u)
SELECT chat_id, title, type, {TS.format('ts')} AS added_at FROM l WHERE rn = 1 AND op = 'upsert'""")
def q_upsert(spark, sf):
    out = R.upsert_sources(FX.sources(spark, sf), FX.source_ops(spark, sf))
    return out.select("chat_id", "title", "type", ts_str(F.col("added_at")).alias("added_at"))


@reg("remove_source", f"""
SELECT chat_id, title, type, {TS.format('added_at')} AS added_at FROM ({_SOURCES_SQL}) s
WHERE chat_id NOT IN (SELECT DISTINCT CAST(user_id % 20 AS BIGINT) FROM events WHERE event_type = 'error' AND user_id % 2 = 0)""")
def q_remove(spark, sf):
    e = FX.table(spark, sf, "events")
    dels = e.where((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).select(
        (F.col("user_id") % 20).cast("bigint").alias("chat_id"))
    out = R.remove_sources(FX.sources(spark, sf), dels)
    return out.select("chat_id", "title", "type", ts_str(F.col("added_at")).alias("added_at"))


@reg("list_sources", f"""
SELECT chat_id, title, type, {TS.format('added_at')} AS added_at FROM ({_SOURCES_SQL}) s""")
def q_list_sources(spark, sf):
    out = R.list_sources(FX.sources(spark, sf))
    return out.select("chat_id", "title", "type", ts_str(F.col("added_at")).alias("added_at"))


@reg("is_processed", f"""
SELECT chat_id, message_id, message_id % 11 = 0 AS is_processed FROM ({O.msgs_sql()}) m""")
def q_is_processed(spark, sf):
    m = FX.msgs(spark, sf).select("chat_id", "message_id")
    return R.with_processed_flag(m, FX.processed_keys(spark, sf))


@reg("mark_processed", f"""
WITH ex AS (SELECT chat_id, message_id, TIMESTAMP '{FX.BASE_TS}' AS processed_at FROM ({O.msgs_sql()}) m WHERE message_id % 11 = 0),
b AS (SELECT CAST(user_id AS BIGINT) AS chat_id, CAST(event_id % 50 AS BIGINT) AS message_id, ts AS processed_at,
             row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts, event_id) AS rn FROM events),
fresh AS (SELECT chat_id, message_id, processed_at FROM b WHERE rn = 1
          AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.chat_id = b.chat_id AND ex.message_id = b.message_id))
SELECT chat_id, message_id, {TS.format('processed_at')} AS processed_at FROM (SELECT * FROM ex UNION ALL SELECT * FROM fresh) u""")
def q_mark(spark, sf):
    ex = FX.processed_keys(spark, sf).withColumn("processed_at", F.lit(FX.BASE_TS).cast("timestamp"))
    out = R.mark_processed(ex, FX.processed_batches(spark, sf))
    return out.select("chat_id", "message_id", ts_str(F.col("processed_at")).alias("processed_at"))


_ST = f"WITH {O.alerts_ctes()}"


@reg("write_alerts", f"""{_ST}
SELECT chat_id, message_id, sx_score, model_score, text_preview, leaks, ocr_text, sender,
       {TS.format('date')} AS date, {TS.format('created_at')} AS created_at, month FROM st""")
def q_write_alerts(spark, sf):
    """S12 round trip: written month-partitioned, read back."""
    a = FX.alerts_table(spark, sf)
    return a.select("chat_id", "message_id", F.col("sx_score").cast("double").alias("sx_score"),
                    F.col("model_score").cast("double").alias("model_score"), "text_preview", "leaks", "ocr_text",
                    "sender", ts_str(F.col("date")).alias("date"), ts_str(F.col("created_at")).alias("created_at"),
                    F.col("month").cast("string").alias("month"))


def _recent_cols(df):
    return df.select("chat_id", "message_id", "sx_score", "model_score", "text_preview",
                     F.size("leaks").cast("bigint").alias("n_leaks"), "ocr_text",
                     F.col("sender.username").alias("sender_username"),
                     ts_str(F.col("date")).alias("date"), ts_str(F.col("created_at")).alias("created_at"))


_RECENT_SEL = f"""SELECT chat_id, message_id, sx_score, model_score, text_preview,
       CAST(json_array_length(leaks) AS BIGINT) AS n_leaks, ocr_text,
       CASE WHEN sender = '{{}}' THEN NULL ELSE json_extract_string(sender, '$.username') END AS sender_username,
       {TS.format('date')} AS date, {TS.format('created_at')} AS created_at"""


@reg("recent_alerts", f"""{_ST}
{_RECENT_SEL} FROM st ORDER BY created_at DESC, chat_id, message_id LIMIT 50""")
def q_recent(spark, sf):
    return _recent_cols(S.recent_alerts(FX.alerts_table(spark, sf), 50))


@reg("recent_alerts_by_source", f"""{_ST}
{_RECENT_SEL} FROM st WHERE chat_id IN (SELECT chat_id FROM ({_SOURCES_SQL}) s)
ORDER BY created_at DESC, chat_id, message_id LIMIT 50""")
def q_recent_src(spark, sf):
    return _recent_cols(S.recent_alerts_by_source(FX.alerts_table(spark, sf), FX.sources(spark, sf), 50))


# --- X1-X16 -------------------------------------------------------------------
@reg("truncate_text", f"""
SELECT chat_id, message_id, {O.cut_sql('text', 500)} AS text FROM ({O.msgs_sql()}) m""")
def q_truncate(spark, sf):
    return FX.msgs(spark, sf).select("chat_id", "message_id", T.truncate_text(F.col("text")).alias("text"))


@reg("compose_full_text", f"""WITH {O.ocr_ctes()}
SELECT m.chat_id, m.message_id, {O.compose_sql('m.text', "CASE WHEN m.media THEN coalesce(o.ocr_text, '') ELSE '' END")} AS full_text
FROM msgs m LEFT JOIN ocr o ON o.message_id = m.message_id""")
def q_compose(spark, sf):
    m = FX.msgs(spark, sf)
    o = FX.ocr_for_messages(spark, sf)
    j = m.join(o, ["chat_id", "message_id"], "left")
    ocr = F.when(F.col("media"), F.coalesce(F.col("ocr_text"), F.lit(""))).otherwise(F.lit(""))
    return j.select("chat_id", "message_id", T.compose_full_text(F.col("text"), ocr).alias("full_text"))


@reg("safe_clean_text", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {O.clean_sql('text')} AS cleaned FROM conversations""")
def q_clean(spark, sf):
    c = FX.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), T.safe_clean_text(F.col("text")).alias("cleaned"))


@reg("text_preview", f"""WITH {O.ocr_ctes()}
SELECT m.chat_id, m.message_id,
       {O.preview_sql(O.compose_sql('m.text', "CASE WHEN m.media THEN coalesce(o.ocr_text, '') ELSE '' END"))} AS text_preview
FROM msgs m LEFT JOIN ocr o ON o.message_id = m.message_id""")
def q_preview(spark, sf):
    m = FX.msgs(spark, sf)
    j = m.join(FX.ocr_for_messages(spark, sf), ["chat_id", "message_id"], "left")
    ocr = F.when(F.col("media"), F.coalesce(F.col("ocr_text"), F.lit(""))).otherwise(F.lit(""))
    return j.select("chat_id", "message_id", T.text_preview(T.compose_full_text(F.col("text"), ocr)).alias("text_preview"))


@reg("response_preview", f"""
SELECT chat_id, message_id, {O.preview_sql('text')} AS text_preview FROM ({O.msgs_sql()}) m""")
def q_resp_preview(spark, sf):
    return FX.msgs(spark, sf).select("chat_id", "message_id", T.text_preview(F.col("text")).alias("text_preview"))


@reg("parse_message_date", f"""
SELECT chat_id, message_id, {TS.format(O.date_sql('date', "TIMESTAMP '" + FX.BATCH_TS + "'"))} AS parsed
FROM ({O.msgs_sql()}) m""")
def q_date(spark, sf):
    m = FX.msgs(spark, sf)
    return m.select("chat_id", "message_id",
                    ts_str(T.parse_message_date(F.col("date"), F.lit(FX.BATCH_TS).cast("timestamp"))).alias("parsed"))


def _conv(spark, sf):
    return FX.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "text")


@reg("ocr_normalize_text", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {O.normalize_sql('text')} AS normalized FROM conversations""")
def q_norm(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", T.ocr_normalize_text(F.col("text")).alias("normalized"))


@reg("correct_ocr_text", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {O.correct_sql('text')} AS corrected FROM conversations""")
def q_correct(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", T.correct_ocr_text(F.col("text")).alias("corrected"))


@reg("ocr_candidate_quality", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {O.quality_sql('text')} AS quality FROM conversations""")
def q_quality(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", T.ocr_candidate_quality(F.col("text")).alias("quality"))


@reg("best_ocr_candidate", f"""WITH {O.ocr_ctes()}
SELECT image_id, ocr_text FROM ocr_best_img""")
def q_best_ocr(spark, sf):
    return best_ocr_text(FX.images(spark, sf), FX.ocr_candidates(spark, sf), FX.ocr_base(spark, sf))


@reg("ocr_variant_gate", """
SELECT CAST(conv_id AS BIGINT) AS image_id, CAST(count(*) AS BIGINT) AS n_reads
FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id""")
def q_gate(spark, sf):
    g = gate_candidates(FX.ocr_candidates(spark, sf))
    return g.groupBy("image_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_reads"))


@reg("text_length", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents""")
def q_len(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("bigint"), T.text_length(F.col("text")).cast("bigint").alias("text_length"))


@reg("word_count", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST({O.word_count_sql('text')} AS BIGINT) AS word_count FROM documents""")
def q_words(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("bigint"), T.word_count(F.col("text")).cast("bigint").alias("word_count"))


@reg("mask_value", f"""
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(pos AS BIGINT) AS pos, tok, {O.mask_sql('tok')} AS masked
FROM (SELECT item_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos
      FROM benchmark) t""")
def q_mask(spark, sf):
    from ..operators.detect import mask
    b = FX.table(spark, sf, "benchmark")
    t = b.select(F.col("item_id").cast("bigint"), F.posexplode(F.split(F.col("text"), " ", -1)).alias("pos", "tok"))
    return t.select("item_id", F.col("pos").cast("bigint"), "tok", mask(F.col("tok")).alias("masked"))


@reg("leaks_to_json", f"""{_ST}
SELECT chat_id, message_id, leaks, CAST(json_array_length(leaks) AS BIGINT) AS n_leaks FROM al""")
def q_leaks_json(spark, sf):
    a = FX.alerts(spark, sf)
    return a.select("chat_id", "message_id", "leaks", F.size(T.leaks_from_json(F.col("leaks"))).cast("bigint").alias("n_leaks"))


@reg("sender_to_json", f"""
SELECT chat_id, message_id, coalesce(to_json(sender), '{{}}') AS sender,
       sender.username AS username FROM ({O.msgs_sql()}) m""")
def q_sender_json(spark, sf):
    m = FX.msgs(spark, sf)
    j = T.sender_to_json(F.col("sender"))
    return m.select("chat_id", "message_id", j.alias("sender"), T.sender_from_json(j)["username"].alias("username"))


# --- A1-A13 -------------------------------------------------------------------
_AN = f"WITH {O.analyzed_ctes()}"


@reg("analyze_messages", f"""{_AN}
SELECT chat_id, message_id, CAST(n_kept AS BIGINT) AS n_kept, model_score, sx_score, alert, has_ocr, ocr_text,
       leaks_json AS leaks FROM an""")
def q_analyze(spark, sf):
    a = FX.analyzed(spark, sf)
    return a.select("chat_id", "message_id", F.size("findings").cast("bigint").alias("n_kept"), "model_score",
                    "sx_score", "alert", "has_ocr", "ocr_text", T.leaks_to_json(F.col("findings")).alias("leaks"))


@reg("alert_flag", f"""{_AN}
SELECT chat_id, message_id, sx_score, alert FROM an""")
def q_alert_flag(spark, sf):
    return FX.analyzed(spark, sf).select("chat_id", "message_id", "sx_score", "alert")


@reg("build_alerts", f"""{_ST}
SELECT chat_id, message_id, sx_score, model_score, text_preview, leaks, ocr_text, sender,
       {TS.format('date')} AS date, {TS.format('created_at')} AS created_at FROM al""")
def q_build_alerts(spark, sf):
    a = FX.alerts(spark, sf)
    return a.select("chat_id", "message_id", "sx_score", "model_score", "text_preview", "leaks", "ocr_text", "sender",
                    ts_str(F.col("date")).alias("date"), ts_str(F.col("created_at")).alias("created_at"))


@reg("alerts_response", f"""{_AN}
SELECT chat_id, message_id, sx_score, model_score, {O.preview_sql('text')} AS text_preview, leaks_json AS leaks,
       has_ocr, ocr_text, coalesce(to_json(sender), '{{}}') AS sender, date FROM an WHERE alert""")
def q_alerts_response(spark, sf):
    return A.alerts_response(FX.analyzed(spark, sf))


@reg("decode_alert_leaks", f"""{_ST}
SELECT chat_id, message_id, json_extract_string(l, '$.type') AS type, json_extract_string(l, '$.value') AS value
FROM (SELECT chat_id, message_id, unnest(CAST(leaks AS JSON[])) AS l FROM st) t""")
def q_decode_leaks(spark, sf):
    d = S.decode_alerts(FX.alerts_table(spark, sf))
    return d.select("chat_id", "message_id", F.explode("leaks").alias("l")).select(
        "chat_id", "message_id", F.col("l.type").alias("type"), F.col("l.value").alias("value"))


@reg("decode_alert_sender", f"""{_ST}
SELECT chat_id, message_id,
       CASE WHEN sender = '{{}}' THEN NULL ELSE CAST(json_extract(sender, '$.id') AS BIGINT) END AS sender_id,
       CASE WHEN sender = '{{}}' THEN NULL ELSE json_extract_string(sender, '$.first_name') END AS first_name
FROM st""")
def q_decode_sender(spark, sf):
    d = S.decode_alerts(FX.alerts_table(spark, sf))
    return d.select("chat_id", "message_id", F.col("sender.id").alias("sender_id"), F.col("sender.first_name").alias("first_name"))


@reg("widen_scores", f"""{_ST}
SELECT chat_id, message_id, sx_score, model_score FROM st""")
def q_widen(spark, sf):
    d = S.decode_alerts(FX.alerts_table(spark, sf))
    return d.select("chat_id", "message_id", "sx_score", "model_score")


@reg("messages_count", f"""
SELECT chat_id, CAST(count(*) AS BIGINT) AS messages_count FROM ({O.msgs_sql()}) m GROUP BY chat_id""")
def q_msg_count(spark, sf):
    return A.messages_count(FX.msgs(spark, sf))


@reg("dashboard_summary", f"""{_ST}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ({_SOURCES_SQL}) s) AS sources_count,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM st WHERE chat_id IN (SELECT chat_id FROM ({_SOURCES_SQL}) s2)
        ORDER BY created_at DESC, chat_id, message_id LIMIT 20) r) AS recent_alerts""")
def q_dashboard(spark, sf):
    src = FX.sources(spark, sf)
    recent = S.recent_alerts_by_source(FX.alerts_table(spark, sf), src, 20)
    return A.dashboard_summary(src, recent)


@reg("risk_band", f"""{_ST}
SELECT chat_id, message_id, CASE WHEN sx_score > 0.8 THEN 'red' ELSE 'yellow' END AS band FROM st""")
def q_band(spark, sf):
    d = S.decode_alerts(FX.alerts_table(spark, sf))
    return d.select("chat_id", "message_id", A.risk_band(F.col("sx_score")).alias("band"))


@reg("leak_list_text", f"""{_ST}
SELECT chat_id, message_id,
       coalesce((SELECT string_agg(json_extract_string(l, '$.type') || ': ' || json_extract_string(l, '$.value'), chr(10) ORDER BY i)
                 FROM (SELECT unnest(CAST(leaks AS JSON[])) AS l, generate_subscripts(CAST(leaks AS JSON[]), 1) AS i) u), '') AS leak_list
FROM st""")
def q_leak_list(spark, sf):
    d = S.decode_alerts(FX.alerts_table(spark, sf))
    return d.select("chat_id", "message_id", A.leak_list_text(F.col("leaks")).alias("leak_list"))


@reg("truncate_words_100", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {O.truncate_words_sql('text')} AS truncated FROM conversations""")
def q_trunc_words(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", A.ocr_column_text(F.col("text")).alias("truncated"))


@reg("alerts_page", f"""{_ST}
SELECT chat_id, message_id, sx_score, {O.truncate_words_sql('ocr_text')} AS ocr_text
FROM st WHERE chat_id IN (SELECT chat_id FROM ({_SOURCES_SQL}) s)
ORDER BY created_at DESC, chat_id, message_id LIMIT 50""")
def q_alerts_page(spark, sf):
    only_sources = A.filter_flag("True")
    a = FX.alerts_table(spark, sf)
    df = S.recent_alerts_by_source(a, FX.sources(spark, sf), 50) if only_sources else S.recent_alerts(a, 50)
    return df.select("chat_id", "message_id", "sx_score", A.ocr_column_text(F.col("ocr_text")).alias("ocr_text"))


@reg("leaks_from_json", f"""{_ST}
SELECT chat_id, message_id, CAST(json_array_length(leaks) AS BIGINT) AS n_leaks,
       json_extract_string(leaks, '$[0].type') AS first_type,
       CAST(json_extract(leaks, '$[0].position') AS BIGINT) AS first_position FROM st""")
def q_leaks_from_json(spark, sf):
    """X15 (decode): stored JSON text back to the findings array."""
    a = FX.alerts_table(spark, sf)
    arr = T.leaks_from_json(F.col("leaks"))
    return a.select("chat_id", "message_id", F.size(arr).cast("bigint").alias("n_leaks"),
                    arr[0]["type"].alias("first_type"), arr[0]["position"].cast("bigint").alias("first_position"))


@reg("sender_from_json", f"""
SELECT chat_id, message_id, sender.id AS sender_id, sender.first_name AS first_name, sender.last_name AS last_name
FROM ({O.msgs_sql()}) m""")
def q_sender_from_json(spark, sf):
    """X16 (decode): sender JSON text back to the struct ('{{}}' -> null)."""
    m = FX.msgs(spark, sf)
    s = T.sender_from_json(T.sender_to_json(F.col("sender")))
    return m.select("chat_id", "message_id", s["id"].alias("sender_id"), s["first_name"].alias("first_name"),
                    s["last_name"].alias("last_name"))
