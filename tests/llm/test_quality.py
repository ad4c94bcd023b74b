import math
import re
from collections import Counter

import pytest
from llm_cases import documents, edge_docs, empty_docs, words

from leakscan.llm import quality as Q


def base(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    win = Counter(zip(w, w[1:], w[2:]))
    again = set()
    for k in range(len(w) - 2):
        if win[tuple(w[k:k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_base(spark, make):
    df = make(spark)
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality(df).collect())
    assert got == sorted((r.doc_id, *base(r.text)) for r in df.collect())


def jsd(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    return math.sqrt(max(0.0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))


def test_distance(spark):
    cases = [([1, 2, 3], [3, 2, 1]), ([5, 0], [0, 7]), ([4, 4], [1, 1]), ([0, 0], [1, 2])]
    df = spark.createDataFrame(cases, "p array<bigint>, q array<bigint>")
    for r in df.selectExpr("p", "q", Q.js_distance_sql("p", "q") + " AS d").collect():
        assert r.d == pytest.approx(jsd(r.p, r.q), abs=1e-12)


def test_histograms_and_verdict(spark):
    rules = Q.QualityRules()
    df = documents(spark)
    feats = {r.doc_id: r for r in Q.features(df).collect()}
    for r in df.collect():
        f, t = feats[r.doc_id], r.text
        assert f.ref_lang == (r.lang if r.lang in Q.COMMON_WORDS else "other")
        listed = Q.COMMON_WORDS[f.ref_lang]
        c = Counter(w.lower() for w in words(t))
        assert f.word_hist[:len(listed)] == [c[w] for w in listed] and sum(f.word_hist) == len(words(t))
        assert f.class_hist[1] == len(re.findall("[A-Z]", t)) and f.class_hist[3] == len(re.findall(r"[\x20\x09-\x0D]", t))
    for r in Q.quality(df).collect():
        n = sum(feats[r.doc_id].class_hist)
        assert r.kept == (not r.base_failed and r.class_distance <= rules.class_limit + rules.class_slack / max(1, n) and r.word_distance <= rules.word_limit)


def test_labelled_documents(spark):
    """Good documents stay; junk that the base rules miss goes, as far as it differs in its characters."""
    d = "/root/testdata/sf0.01"
    got = Q.quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0
    assert n.get((0, False), 0) > n.get((0, True), 0)


def test_no_python_on_the_path(spark):
    df = Q.judge(Q.features(documents(spark)), Q.references(Q.features(documents(spark))))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_keep_is_the_verdict_of_quality(spark):
    for make in (documents, edge_docs, empty_docs):
        df = make(spark)
        kept = sorted(repr(r.doc_id) for r in Q.quality(df).collect() if r.kept)
        out = Q.keep(df)
        assert out.columns == df.columns and sorted(repr(r.doc_id) for r in out.collect()) == kept
