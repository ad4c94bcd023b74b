import hashlib
import random

import numpy as np
import pytest
from llm_cases import documents, edge_docs, edge_rows, empty_docs, texts_of

from leakscan.llm import suffix_dedup as S


def want(rows):
    """By all 100-byte strings and their first places."""
    key = [(S.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in key:
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (doc, _), (d, b) in zip(rows, key):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 99):
            if first[b[i:i + 100]] < (d, i):
                gone[i:i + 100] = True
        g = gone[:len(b)]
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((doc, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(spark):
    """Shared passages at odd places, periodic texts, copies and near copies."""
    rnd = random.Random(5)
    p = ["".join(rnd.choice("abcdefgh éß\n") for _ in range(n)) for n in (100, 101, 150, 260, 900)]
    rows = []
    for k in range(60):
        parts = ["".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 200))) for _ in range(3)]
        rows.append((k, parts[0] + rnd.choice(p) + parts[1] + rnd.choice(p) + parts[2]))
    rows += [(60, "a" * 500), (61, "ab" * 300), (62, "a" * 99), (63, rows[3][1]), (64, rows[3][1]), (65, "\x00" * 250), (None, rows[5][1] + "!"), (-5, rows[7][1])]
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, bytes string, spans int")


@pytest.mark.parametrize("make", [documents, edge_docs, passages, empty_docs])
def test_against_all_strings(spark, make, monkeypatch):
    monkeypatch.setattr(S, "COLLECTION", 1 << 14)
    df = make(spark)
    if make is edge_docs:    # brute force over the long text would take a while
        df = edge_docs(spark, [r for r in edge_rows() if len(r[1] or "") < 10_000])
    got = sorted((tuple(r) for r in S.digests(S.spans(df)).collect()), key=repr)
    assert got == want(texts_of(df))


def test_hot_anchor_by_windows(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    df = passages(spark)
    assert sorted((tuple(r) for r in S.digests(S.spans(df)).collect()), key=repr) == want(texts_of(df))


def test_parts_of_a_long_text(monkeypatch):
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"abc \n") for _ in range(5000))
    whole = S.runs(text)
    monkeypatch.setattr(S, "FLAT", 700)
    part = S.runs(text)
    spread = [[(a + k, g) for a, n, g in zip(*(x.tolist() for x in r)) for k in range(n)] for r in (whole, part)]
    assert spread[0] == spread[1]


def test_collection():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"abcd\x00\xff") for _ in range(700))
    strings = [base[a:a + rnd.randint(100, 150)] for a in (rnd.randint(0, 550) for _ in range(80))] + [b"a" * 130, b"ab" * 70]
    got, exp = {}, {}
    for s, o, g in zip(*(x.tolist() for x in S.collect(strings))):
        got.setdefault(g, set()).add((s, o))
    for i, x in enumerate(strings):
        for k in range(len(x) - 99):
            exp.setdefault(x[k:k + 100], set()).add((i, k))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, exp.values()))


def test_remove_keeps_columns_and_whole_characters(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("éèàüñ") for _ in range(80))
    rows = [(1, "x" + t, "en"), (2, "yy" + t + "z", "de"), (3, None, None), (4, "", "fr")]
    df = spark.createDataFrame([(d, x, lang, 5) for d, x, lang in rows], "doc_id bigint, text string, lang string, n_chars bigint")
    out = {r.doc_id: r for r in S.remove(df).collect()}
    assert S.remove(df).columns == df.columns
    assert out[1].text == "x" + t and out[2].text == "yyz" and out[2].n_chars == 3 and out[3].text is None and out[4].text == ""


def test_different_texts_with_one_id_or_none(spark):
    rnd = random.Random(3)

    def own(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    p, q = own(150), own(130)
    rows = []
    for d in (None, 7):         # the long text's passage starts where the short one has ended
        rows += [(d, own(500) + p + own(350)), (d, own(60) + p + own(90)), (d, own(200) + q), (d, own(200) + q + own(5)), (d, q + own(40) + q)]
    rows += [rows[0], rows[6], (9, rows[2][1]), (3, own(20) + q)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = df.selectExpr("coalesce(doc_id, 9223372036854775807) AS d", "xxhash64(text) AS c1", "xxhash64(7, text) AS c2", "text").collect()
    by = [((r.d, r.c1, r.c2), r.text.encode()) for r in key]
    first = {}
    for d, b in by:
        for i in range(len(b) - 99):
            first[b[i:i + 100]] = min(first.get(b[i:i + 100], (d, i)), (d, i))
    exp = []
    for d, b in by:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if first[b[i:i + 100]] < (d, i):
                gone[i:i + 100] = True
        exp.append((None if d[0] == S.LAST else d[0], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum())))
    got = [(r.doc_id, r.kept_sha256, r.n_removed) for r in S.digests(S.spans(df)).collect()]
    assert sorted(got, key=repr) == sorted(exp, key=repr)
    assert sum(n for *_, n in exp) > 1000


def test_remove_cuts_in_one_python_step(spark):
    """Chained Python steps would take two workers a core, which stay beside the stages that follow."""
    plan = S.remove(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_strings_of_many_texts_travel_together(monkeypatch):
    """A batch of its own for each text cost more than its strings."""
    import pyarrow as pa
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randint(0, 900))) for _ in range(300)]
    gs = [sorted(set(S.runs(t)[2].tolist()))[::2] or None for t in texts]
    want = []
    for k, t in enumerate(texts):
        first = {}
        for at, n, g in zip(*(x.tolist() for x in S.runs(t))):
            if g in (gs[k] or []):
                first.setdefault((g, t[at:at + n + 99]), at)
        want += [(g, s, k, at) for (g, s), at in first.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.binary()), pa.array(gs, pa.list_(pa.int64()))], names=["key", "bytes", "gs"])
    for size in (S.FLAT, 2000):
        monkeypatch.setattr(S, "FLAT", size)
        got = list(S.string_batches([batch]))
        assert len(got) < 100 and (size > 2000 or len(got) > 10)
        assert [tuple(r[c] for c in ("g", "s", "key", "start")) for b in got for r in b.to_pylist()] == want
