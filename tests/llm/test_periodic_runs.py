import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_cases import documents, edge_docs, empty_docs, texts_of, words

from leakscan.llm import periodic_runs as P


def runs_of(w):
    """All (start, period, length), by trying every period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def expected(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(w)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def some_words(rng):
    n = rng.choice([0, 1, 5, 6, 7, 30, 120])
    w = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        p, a = rng.randrange(1, 12), rng.randrange(n)
        w = w[:a] + [w[a:a + p][(i - a) % len(w[a:a + p])] for i in range(a, n)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        got = [[] for _ in texts]
        for t, s, n, p in zip(*(c.tolist() for c in P.runs(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64)))):
            got[t].append((s, p, n))
        assert got == [runs_of(w) for w in texts]


def test_extensions_are_exact_both_ways():
    rng = random.Random(7)
    for _ in range(200):
        w = some_words(rng) + some_words(rng)
        n = len(w)
        if n < 2:
            continue
        s = np.array([1000, *w, 1001], np.int64)
        g = P.Grammar(s, s >= 1000)
        pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
        i, j = (np.array(c, np.int64) for c in zip(*pairs))
        ahead, behind = g.extend(i, j, True), g.extend(i, j, False)
        for (a, b), x, y in zip(pairs, ahead.tolist(), behind.tolist()):
            assert x == next(k for k in range(n + 2) if s[a + k] != s[b + k])
            assert y == next(k for k in range(n + 2) if s[a - k] != s[b - k])


def test_grammar_is_logarithmic_on_repetitions():
    s = np.array([9, *([1, 2, 3] * 5000), 8], np.int64)
    g = P.Grammar(s, s > 5)
    assert len(g.levels) < 80 and len(g.top) == 3
    assert sum(len(level[0]) for level in g.levels) < 12 * len(s)


def test_one_word_ten_thousand_times():
    t, s, n, p = P.runs(np.zeros(10_000, np.int64), np.array([10_000], np.int64))
    assert (t.tolist(), s.tolist(), n.tolist(), p.tolist()) == ([0], [0], [10_000], [1])


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_digests_equal_brute_force(spark, make):
    df = make(spark)
    small = [(d, t) for d, t in texts_of(df) if len(t or "") < 20000]
    want = sorted(map(repr, (expected(d, t) for d, t in small)))
    got = P.digests(df.where("coalesce(length(text), 0) < 20000")).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert P.digests(df).count() == df.count()


def test_long_text_and_null_id(spark):
    text = "wort für wört " * 20000
    rows = [(None, text), (None, None), (7, text)]
    got = P.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        if r.runs:
            assert [tuple(x) for x in r.runs] == [(0, 60000, 3)] and r.collapsed == "wort für wört"
        else:
            assert r.collapsed == ""
    assert sum(bool(r.runs) for r in got) == 2
