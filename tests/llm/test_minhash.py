import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, edge_docs, empty_docs, texts_of, words

from leakscan.llm import minhash as M


def shingles(t):
    w = words(t)
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def linked(a, b):
    inter, union = sum((a & b).values()), sum((a | b).values())
    return union > 0 and 10 * inter >= 8 * union


def want(rows):
    """(doc_id, class_id, component_id) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                up[find(i)] = find(j)
    comp, cls = {}, {}
    for k, (d, t) in enumerate(rows):
        comp[find(k)] = min(comp.get(find(k), d), d)
        cls[t] = min(cls.get(t, d), d)
    return sorted((d, cls[t] if words(t) else d, comp[find(k)]) for k, (d, t) in enumerate(rows))


def near(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.choice([30, 200, 600]))]
        for c in range(rnd.choice([1, 3, 9])):
            t = list(base)
            for _ in range(len(t) * c // 400):
                t[rnd.randrange(len(t))] = "z" + str(rnd.random())
            rows.append((len(rows), " ".join(t)))
    return spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id bigint, text string, c1 string, bands int")


def run(df):
    return sorted((r.doc_id, r.class_id, r.component_id) for r in M.per_row(M.near_duplicates(df)).collect())


@pytest.mark.parametrize("make", [documents, edge_docs, near, empty_docs])
def test_against_all_pairs(spark, make):
    df = make(spark)
    assert run(df) == want(texts_of(df))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_UNITS", 300)
    df = near(spark)
    assert run(df) == want(texts_of(df))


def chain(spark):
    """A chain of texts, each near the one before only; three copies of one text a word apart; and rows of both repeated."""
    rnd = random.Random(8)
    cur, rows = [f"w{k}" for k in range(300)], []
    for _ in range(25):
        cur = list(cur)
        k = rnd.randrange(270)
        cur[k:k + 20] = [f"q{rnd.random()}" for _ in range(20)]
        rows.append((len(rows), " ".join(cur)))
    for k in range(40):
        rows.append((len(rows), " ".join([f"v{j}" for j in range(100)] + [f"x{k}"])))
    rows += [rows[3], rows[50], rows[50]]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("rounds, pairs", [(400, 10_000), (400, 700), (10_000, 10_000)])
def test_rounds_lose_no_link(spark, monkeypatch, rounds, pairs):
    monkeypatch.setattr(M, "ROUND_UNITS", rounds)
    monkeypatch.setattr(M, "BLOCK_UNITS", pairs)
    df = chain(spark)
    assert run(df) == want(texts_of(df))


def test_keep_one(spark):
    df = edge_docs(spark)
    out = M.keep_one(df).collect()
    ids = sorted(r.doc_id for r in out)
    assert ids == list(range(12)) + [13] and M.keep_one(df).columns == df.columns    # 12 = 11, the repeated row 5 once


def test_signature_estimates_similarity():
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(500)]
    other = [w if rnd.random() > 0.02 else "q" + str(rnd.random()) for w in base]
    texts = [" ".join(base), " ".join(other), "short text", "short text"]
    units, n = M.Shingler().units(texts)
    sig = M.signatures(units, n)
    a, b = shingles(texts[0]), shingles(texts[1])
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1 and (sig[2] == sig[3]).all()
    alone = M.signatures(units[:n[0]], n[:1])
    assert (alone[0] == sig[0]).all()


def test_pivots_find_chains():
    rnd = np.random.default_rng(3)
    cur, sets = np.arange(200), []
    for _ in range(15):
        sets.append(np.sort(cur.astype(np.uint64)))
        cur = cur.copy()
        cur[rnd.choice(200, 15, replace=False)] = rnd.integers(10**6, 10**9, 15)
    u = M._Union(15)
    for i, j in M.links(sets, list(range(15))):
        u.join(i, j)
    assert len({u.find(k) for k in range(15)}) == 1


def test_a_column_is_signed_without_sorting_darts(monkeypatch):
    """Words are told apart by Arrow's kernels, ranks reach their coordinates unsorted."""
    import re

    import pyarrow as pa
    rnd = random.Random(6)
    texts = [None, "", "a", "a b\x0bc", "\x85 d\x1ce"] + [" ".join(rnd.choice(["ab", "é", "ü　x", "the", "\n", "q\x1d"]) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    column = pa.array(["dropped", *texts], pa.string())[1:]
    units, n = M.Shingler().units(column)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert n.tolist() == [max(len(w) - 4, 1) if w else 0 for w in words]
    alone = [M.signatures(*M.Shingler().units([t]))[0] for t in texts]

    def sorting(*_, **__):
        raise AssertionError("darts are sorted")

    monkeypatch.setattr(M.np, "lexsort", sorting)
    got = M.signatures(units, n)
    assert (got == np.array(alone)).all() and (got < 2**64 - 1).all()
