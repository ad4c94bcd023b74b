"""The keyword pre-gates are exact: every character that Java's (?iU)
equates with a keyword letter, other than by lower(), is in the fold map."""
from pyspark.sql import functions as F

from leakscan.operators.detect import _GATES, FOLD_FROM, FOLD_PRE, FOLD_TO


def test_fold_covers_java_case_equivalences(spark):
    words = [w for clauses in _GATES.values() for clause in clauses for kind, w in clause if kind == "f"]
    letters = sorted({c for w in words for c in w if c.isalpha()})
    cps = spark.range(0, 0x10000).where("id < 55296 OR id > 57343").select(F.col("id").cast("int").alias("cp"))
    ch = cps.select(F.expr("decode(unhex(lpad(hex(cp), 4, '0')), 'UTF-16BE')").alias("ch"))
    conds = [F.when(F.col("ch").rlike("(?iU)^" + c + "$") & (F.lower("ch") != F.lit(c)), F.lit(c)) for c in letters]
    found = {(r.ch, c) for r in ch.select("ch", F.array_compact(F.array(*conds)).alias("m"))
             .where(F.size("m") > 0).collect() for c in r.m}
    mapping = dict(zip(FOLD_FROM, FOLD_TO))
    mapping[FOLD_PRE[0]] = FOLD_PRE[1]
    for chx, c in found:
        assert mapping.get(chx) == c, (hex(ord(chx)), c)


def test_gates_are_told_by_bytes(spark):
    """No regular expression reads whole texts for Cyrillic letters or fold characters, and no text is searched
    for the words of a detector whose cheap conditions fail."""
    from leakscan import catalog as C
    from leakscan.operators.detect import _asked_for, _with_helpers
    texts = ["plain ascii", "Ӿ", "ᲀ", "İ", "ı login", "ſ", "ᲆ", "é ü 日本", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    helpers = _with_helpers(df, "text", C.DETECTORS)
    plan = helpers._jdf.queryExecution().optimizedPlan().toString()
    assert f"[{FOLD_PRE[0]}{FOLD_FROM}]" not in plan and "Ѐ" not in plan
    got = {r.id: r for r in helpers.select("id", "_cyr", "_fold").collect()}
    assert [got[k]["_cyr"] for k in range(10)] == [False, True, True, False, False, False, True, False, False, False]
    assert [got[k]["_fold"] for k in range(10)] == ["plain ascii", "ӿ", "в", "i", "i login", "s", "ъ", "é ü 日本", None, ""]
    assert _asked_for(("f", "mail.ru"), C.DETECTORS) and _asked_for(("f", "pass"), C.DETECTORS) is None
