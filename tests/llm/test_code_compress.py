import hashlib
import random

import numpy as np
import pytest
from llm_cases import SF

from leakscan.llm import code_compress as C

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, v int"


def kept(rows):
    return [(i, [float(x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def expected(rows):
    """Everything in Python's integers, one length at a time."""
    out, books_of = [], {}
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for dim in sorted({len(v) for _, v, _ in rows}):
        own = [r for r in rows if len(r[1]) == dim]
        edges = C.cuts(dim)
        ints = [[int(np.floor(4096 * x)) for x in v] for _, v, _ in own]
        parts = [[x[edges[k]:edges[k + 1]] for x in ints] for k in range(8)]
        codes = []
        errors = [0] * len(own)
        books = []
        for k in range(8):
            book = [list(p) for p in parts[k][:16]]
            for rnd in range(7):
                code = []
                dist = []
                for p in parts[k]:
                    d = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book]
                    code.append(d.index(min(d)))
                    dist.append(min(d))
                if rnd < 6:
                    for e in range(len(book)):
                        mine = [p for p, c in zip(parts[k], code) if c == e]
                        if mine:
                            book[e] = [sum(col) // len(mine) for col in zip(*mine)]
            codes.append(code)
            books.append(book)
            errors = [a + b for a, b in zip(errors, dist)]
        books_of[dim] = books
        for n, r in enumerate(own):
            out.append((r[0], "".join(f"{codes[k][n]:02x}" for k in range(8)), errors[n], r[2]))
    digest = hashlib.sha256(",".join(str(x) for d in sorted(books_of) for book in books_of[d] for e in book for x in e).encode()).hexdigest()
    by = {}
    for _, _, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    return sorted(map(repr, ((i, c, e, by[lab], digest) for i, c, e, lab in out)))


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    return sorted(repr(tuple(r)) for r in C.with_label_error(*C.compress(df)).collect())


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = C.with_label_error(*C.compress(df)).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(repr(tuple(r)) for r in got) == expected(rows)


def test_edges(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(16)], [None, 1, 2][k % 3]) for k in range(60)]
    rows += [rows[5], (5, [0.5] * 16, 1), (None, [0.25] * 16, None)]                    # repeated row and id, null id
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 2), (103, [0.1] * 15 + [float("inf")], 2)]
    rows += [(200 + k, [rng.uniform(-1, 1) for _ in range(11)], 1) for k in range(9)]   # another length, not divisible, few rows
    rows += [(300, [], 4), (301, [], None)]
    rows += [(400 + k, [0.0] * 16, 3) for k in range(20)]                               # ties
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows[::-1]) == expected(rows)


def test_large_integers(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 12, 19]) for _ in range(16)], k % 2) for k in range(40)]
    assert run(spark, rows) == expected(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("bits", [None, 5, 11])
def test_limbs_are_exact(bits):
    rng = np.random.default_rng(1)
    for top in (3, 1 << 12, 1 << 27, 1 << 29):
        a = rng.integers(-top, top + 1, (50, 8))
        b = rng.integers(-top, top + 1, (16, 8))
        want = a.astype(object) @ b.T.astype(object)
        assert (C.exact_dot(a, b, bits) == want).all()
        assert (C.distances(a, b) == ((a[:, None].astype(object) - b[None].astype(object)) ** 2).sum(2)).all()


def test_one_limb_would_not_do():
    a = np.full((1, 8), (1 << 29) - 1, np.int64)
    assert float((a.astype(float) @ a.T.astype(float))[0, 0]) != int((a.astype(object) @ a.T.astype(object))[0, 0])
    assert C.exact_dot(a, a)[0, 0] == 8 * ((1 << 29) - 1) ** 2


def test_ties_take_the_lower_entry():
    v = np.array([[0, 0]], np.int64)
    assert C.assign(np.tile(v, (1, 8)), [[[1, 0], [0, 1], [1, 0]]] * 8)[0].tolist() == [[0] * 8]
