"""The folds give exactly the spans of ``re.finditer``, in linear time."""
import random
import re
import time

from pyspark.sql import functions as F

from leakscan import catalog as C
from leakscan.functions.config_spans import config_spans_sql

PATTERN = next(d for d in C.DETECTORS if d.name == "config_fragment")
RE = re.compile(next(row[1] for row in C.DETECTOR_TABLE if row[0] == "config_fragment"))
PARTS = ["{", "}", ":", '"', "'", "\n", " ", "key", "pass", "pwd", "token", "secret", "password", "api_key", "passecret", "x", "я", "- ", "- a: b",
         ": ", ":\n", ':"', "{}", '"}', "'}", "\t", "pas", "\ue000", "\ue001", "-", "\x1c"]
FIXED = ["", "{key:x}", "{key:}", "{key: }", '{key:"}', '{key: "}', '{key:""}', '{key:"a"}', '{key:"a}b"', "{key:a\nb}{key:c}", "{key:\n}{key:y}",
         "{a {key: x} } {pwd: 'y'}", "{key: a: b} c: d}", "a}: {key:x", "{key:{key:{key:", "- a: b {key:- c: d} - e: f", "{ - a: b", "{x:key}", "{key}:x}",
         "{token\n:x}", "{token: x\n\n}\n{pass:'1'}", "{key:'}'}", "{key:x'}", "{key:x'} y'}", '{key:"x" : y}', "{api_key:1}{api_key:2}", "{{{{key::::}}}}"]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    rows = df.select("id", F.expr(config_spans_sql("text")).alias("s")).collect()
    return {r.id: [(x.pos, x.raw) for x in r.s] for r in rows}


def test_equal_to_finditer(spark):
    rng = random.Random(11)
    texts = FIXED + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(6000)]
    some = ["{", "}", ":", "key", '"', " ", "\n"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(5, 40))) for _ in range(6000)]
    got = found(spark, texts)
    n = 0
    for k, t in enumerate(texts):
        want = [(m.start(), m.group()) for m in RE.finditer(t)]
        assert got[k] == want, (t, got[k], want)
        n += len(want)
    assert n > 3000


def test_long_lines_are_linear(spark):
    m = 1 << 20
    texts = ["{" * m, "{key " * (m // 5) + "}:", "{key:" * (m // 5) + "}", "}{key:" * (m // 6), "{key: x" * (m // 7) + "'}",
             "{ } : key " * (m // 10), '{key:"' * (m // 6) + "}"]
    found(spark, ["{key:x}"])
    for t in texts:
        start = time.time()
        got = found(spark, [t])
        took = time.time() - start
        assert took < 20, (t[:20], took)
        assert len(got[0]) <= 1
    start = time.time()
    assert found(spark, [texts[0]])[0] == []
    assert time.time() - start < 2
