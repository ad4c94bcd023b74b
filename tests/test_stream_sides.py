"""The micro-batches of a stream query read the registry and the OCR texts; they don't derive them anew."""

from leakscan.plans import fixtures as FX
from leakscan.plans import stream_queries as SQ
from leakscan.streaming import scan_stream as SS


def test_batches_read_written_sides(spark, tmp_path, monkeypatch):
    rows = [(3 * i, "chat") for i in range(5)]
    made = {"sources": spark.createDataFrame(rows, "chat_id bigint, title string"),
            "ocr": spark.createDataFrame([(3, 1, "text"), (3, 1, None)], "chat_id bigint, message_id bigint, ocr_text string")}
    monkeypatch.setattr(FX, "sources", lambda *_: made["sources"])
    monkeypatch.setattr(FX, "ocr_for_messages", lambda *_: made["ocr"])
    sides = SQ._sides(spark, "", {k: f"file://{tmp_path}/{k}" for k in made})
    for k, df in sides.items():
        assert all(str(tmp_path) in f for f in df.inputFiles()) and df.inputFiles()
        assert df.schema == made[k].schema and sorted(df.collect(), key=str) == sorted(made[k].collect(), key=str)


def test_every_stream_query_hands_them_over(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(SQ, "_sides", lambda *_: seen.append(1) or {"sources": None, "ocr": None})
    monkeypatch.setattr(SQ, "_land", lambda *a, **k: None)
    monkeypatch.setattr(SQ, "_alerts_out", lambda *a: None)
    monkeypatch.setattr(SS, "process_batch", lambda *a, **k: None)

    class Query:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(SS, "read_message_stream", lambda *a, **k: None)
    monkeypatch.setattr(SS, "start_scan_stream", lambda *a, **k: Query())
    p = SQ._paths(spark, "test")
    SQ._run(spark, "", p)
    assert seen == [1]
