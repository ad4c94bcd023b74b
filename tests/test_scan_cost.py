"""The scan looks a gate word up once per message, and F2-F6 scan only what the gates let through."""

import re
import time

import pytest
from pyspark.sql import functions as F

from leakscan import catalog as C
from leakscan.operators import detect as D

NAMES = "Иванов Иван Иванович"
TEXTS = [
    None, "", "  ", "plain words", "İ пароль: qwerty1 ſecret: abcd1234 Key=abcdef",
    "ᲀод Паспорт 4510 123456 " + NAMES + ", тел 89161234567, дом 5, номер паспорта", NAMES + "а " + NAMES + " паспортномер " + NAMES + " дом",
    "ёлка Ёж Ёлка - серия паспорта 8(916)123-45-67", "1234567890 12.05.1990 4111 1111 1111 1111 112-233-445 95 10.0.0.1",
    "ЛОГИН: bob ПАРОЛЬ: qwerty123 SEED: " + "apple " * 12, "API_KEY='ABCDEFGHIJKLMNOPQRSTUVWX' фразы улица Ленина, д. 5", "x7 916 123 45 67y серия 1234 и 123456",
]


def _plain(spark, df, d):
    """Spans of a detector's own pattern, found without gates."""
    found = df.select("id", F.expr(D.spans_sql("`text`", d.java_pattern)).alias("s")).collect()
    return {r["id"]: [(x["pos"], x["raw"]) for x in r["s"]] for r in found if r["s"]}


@pytest.mark.parametrize("name", sorted({*D._FIRST_LETTERS, *D._FIRST_CLASS, *D._FROM_LETTERS_START, "fio"}))
def test_gated_steps_are_the_matches_of_the_plain_pattern(spark, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    d = C.DETECTOR_BY_NAME[name]
    got = {r["id"]: [(x["pos"], x["raw"]) for x in r["steps"]] for r in D.with_finding_steps(df, detectors=[d]).collect() if r["steps"]}
    blank = {i for i, t in enumerate(TEXTS) if not (t or "").strip()}
    assert got == {k: v for k, v in _plain(spark, df, d).items() if k not in blank}


def test_steps_are_gated_and_words_are_looked_up_once(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    for scan in (D.with_finding_steps, D.with_raw_findings):
        plan = scan(df)._jdf.queryExecution().optimizedPlan().toString()
        words = re.findall(r"Contains\(_fold#\d+, [^)]*\)", plan)
        assert words and len(words) == len(set(words))
        assert not re.search(r"instr\(_fold", plan)


def test_three_names_are_tried_once_a_word(spark):
    # words of 2,000 letters: tried from every letter this had not ended after 37 s, now it takes 10 s
    text = ("а" * 2000 + " ") * 60
    df = spark.createDataFrame([(1, text + "паспорт номер 5")], "id int, text string")
    began = time.time()
    D.with_finding_steps(df, detectors=[C.DETECTOR_BY_NAME["passport_fio_combo"]]).collect()
    assert time.time() - began < 30
