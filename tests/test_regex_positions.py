"""The native match-with-position trick equals Python ``finditer``."""
import re

import random

from leakscan.catalog import DETECTORS
from leakscan.operators.detect import scan_pattern
from leakscan.functions.regex import OPEN, match_spans

PIECES = ["Паспорт 4510 123456", "a@b.co ", "+7(916)123-45-67", " 10.1.2.3 ", "login: x password: yyyy ",
          "серия 4510 номер 123456", "иван иванов иванович ", "4276 1234 5678 9012", "\n", "  ", "ё", "x",
          "12.05.1990", "{pwd: 'z'}", "- a: b", OPEN, "eyJa.eyJb.c", "ул. Ленина, д. 5"]


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    cols = [match_spans("t", scan_pattern(d)).alias(f"m{d.no}") for d in DETECTORS]
    for r in df.select("id", "t", *cols).collect():
        for d in DETECTORS:
            want = [(m.start(), m.group(0)) for m in re.finditer(d.pattern, r.t)]
            got = [(s.pos, s.raw) for s in r[f"m{d.no}"]]
            assert got == want, (d.name, r.t)


def test_fixed_texts(spark):
    check(spark, ["", "".join(PIECES), OPEN + "a@b.co x" + OPEN, "Серия 4510 номер 123456 и серия 1234 567890"])


def test_random_concatenations(spark):
    rnd = random.Random(7)
    check(spark, ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(60)])
