"""Golden inputs of the scalar operators (FIXTURES §4) and edge cases."""
import datetime as dt

from pyspark.sql import functions as F

from leakscan import catalog as C
from leakscan.functions import text as T
from leakscan.operators.detect import mask


def one(spark, col, rows, schema="t string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_parse_date(spark):
    batch = dt.datetime(2030, 1, 1)
    got = one(spark, T.parse_message_date(F.col("t"), F.lit(batch)),
              [("2024-01-02T03:04:05+03:00",), ("2024-01-02T03:04:05.678Z",), ("2024-01-02T03:04:05-05:00",),
               (None,), ("garbage",), ("2024-01-02",)])
    want = [dt.datetime(2024, 1, 2, 3, 4, 5)] * 3 + [batch, batch, dt.datetime(2024, 1, 2)]
    assert got == want


def test_safe_clean(spark):
    got = one(spark, T.safe_clean_text(F.col("t")), [("",), ("a_b\tc №5",), ("a" * 1001,), ("   ",), ("x y",)])
    assert got == ["", "a?b c ?5", C.OCR_CLEAN_SENTINEL, C.OCR_CLEAN_SENTINEL, "x y"]


def test_correct_ocr(spark):
    assert one(spark, T.correct_ocr_text(F.col("t")), [("4510 12",), ("",)]) == ["чSIо I2", ""]


def test_mask(spark):
    got = one(spark, mask(F.col("t")), [("a" * 8,), ("abcdefghi",), ("abcdefghijkl",), ("abcdefghijklm",)])
    assert got == ["a" * 8, "abcd...fghi", "abcd...ijkl", "abcdef...hijklm"]


def test_compose(spark):
    df = spark.createDataFrame([("t", ""), ("", "o"), ("t", "o")], "t string, o string")
    got = [r[0] for r in df.select(T.compose_full_text(F.col("t"), F.col("o"))).collect()]
    assert got == ["t", "o", "t [OCR] o"]


def test_message_text(spark):
    got = one(spark, T.message_text(F.col("t")), [(None,), ("",), ("x" * 501,), ("ok",)])
    assert got == [C.EMPTY_MESSAGE_TEXT, C.EMPTY_MESSAGE_TEXT, "x" * 500 + "...", "ok"]


def test_truncate_words(spark):
    s = "word " * 30
    got = one(spark, T.truncate_words(F.col("t")), [(s,), ("x" * 120,), ("short",), ("a" * 104,)])
    assert got[0].endswith("...") and len(got[0]) <= 100 and not got[0][:-3].endswith(" ")
    assert got[1] == "x" * 97 + "..."
    assert got[2:] == ["short", "a" * 104]


def test_best_ocr_sentinel(spark):
    from leakscan.operators.ocr import best_ocr_text
    imgs = spark.createDataFrame([(1,), (2,), (3,)], "image_id bigint")
    cands = spark.createDataFrame(
        [(2, 0, 0, 100, 100, "hello world 1234"), (2, 0, 1, 100, 100, "hello world 1234"),
         (3, 0, 0, 100, 40, "too small image")],
        "image_id bigint, variant_no int, param_no int, width int, height int, text string")
    base = spark.createDataFrame([(3, "base read")], "image_id bigint, text string")
    got = {r.image_id: r.ocr_text for r in best_ocr_text(imgs, cands, base).collect()}
    assert got[1] == C.OCR_NOT_RECOGNISED
    assert got[2] == "hello world I2зч"
    assert got[3] == "base read"


def test_json_roundtrip(spark):
    df = spark.createDataFrame([((1, "u", None, None),), (None,)],
                               "s struct<id:bigint,username:string,first_name:string,last_name:string>")
    j = [r[0] for r in df.select(T.sender_to_json(F.col("s"))).collect()]
    assert j == ['{"id":1,"username":"u","first_name":null,"last_name":null}', "{}"]
