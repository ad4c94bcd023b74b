"""Message ids are per chat: OCR text and attachments must not leak into another chat."""
from leakscan.operators.alerts import score_messages
from leakscan.sources.messages import MESSAGE_SCHEMA, attachment_bytes


def test_ocr_and_attachments_stay_in_their_chat(spark):
    rows = [(c, 5, None, 1, "hello", False, False, True, None) for c in (1, 2)]
    names = ["chat_id", "message_id", "date", "sender_id", "text", "is_forward", "out", "media", "sender"]
    empty = spark.createDataFrame([], MESSAGE_SCHEMA)
    msgs = spark.createDataFrame([tuple(r[names.index(c)] if c in names else None for c in empty.columns) for r in rows], empty.schema)
    if "model_score" not in msgs.columns:
        msgs = msgs.selectExpr("*", "cast(null as decimal(5,3)) AS model_score")
    ocr = spark.createDataFrame([(1, 5, "photo of chat 1"), (1, 5, "second read")], "chat_id bigint, message_id bigint, ocr_text string")
    got = {r.chat_id: r.full_text for r in score_messages(msgs, ocr).select("chat_id", "full_text").collect()}
    assert got == {1: "hello [OCR] photo of chat 1", 2: "hello"}
    att = spark.createDataFrame([(1, 5, bytearray(200))], "chat_id bigint, message_id bigint, content binary")
    assert {r.chat_id: r.content is not None for r in attachment_bytes(msgs, att).collect()} == {1: True, 2: False}
