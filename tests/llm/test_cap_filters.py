import numpy as np
import pytest

from leakscan.llm import cap_filters as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, f int"


def planted(seed=1, groups=25, members=12):
    """Groups around random centres at several distances, crowded copies, and odd vectors."""
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rnd.standard_normal(64)
        c /= np.linalg.norm(c)
        for _ in range(members):
            rows.append(c + rnd.standard_normal(64) * rnd.choice([0.0, 0.01, 0.025, 0.03, 0.04]))
    rows += [rows[0]] * 30 + [rows[5] * 1e-30, rows[7] * 1e30] + [rnd.standard_normal(64) for _ in range(300)]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    nan = float("nan")
    odd = [None, [0.0] * 64, [nan] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 63, []]
    return [(k, r, 1, "clash", 2) for k, r in enumerate(rows + odd)] + [(0, rows[0], 1, "clash", 2)]


def want(rows):
    good = [k for k, r in enumerate(rows) if r[1] and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([rows[k][1] for k in good], float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = np.array([rows[k][0] for k in good])
    while True:
        low = np.minimum(comp, np.where(hit, comp[None, :], 10**9).min(1))
        if (low == comp).all():
            break
        comp = low
    out = {k: (r[0], 0, r[0]) for k, r in enumerate(rows)}
    for i, k in enumerate(good):
        out[k] = (rows[k][0], int(hit[i].sum()), int(comp[i]))
    return out


def run(spark, rows):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in C.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect())


def test_recall_and_components(spark):
    rows = planted()
    got, exp = run(spark, rows), sorted(want(rows).values())
    links, true = sum(r[1] for r in got), sum(r[1] for r in exp)
    assert true > 2000 and links <= true and links >= 0.99 * true
    assert all(g[1] <= e[1] for g, e in zip(got, exp))
    assert np.mean([g[2] == e[2] for g, e in zip(got, exp)]) > 0.99


def test_blocks_give_the_same(spark, monkeypatch):
    rows = planted(seed=2, groups=4, members=60)
    whole = run(spark, rows)
    monkeypatch.setattr(C, "BLOCK", 7)
    assert run(spark, rows) == whole


def test_list_decoding_is_complete():
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = C.code(codes=12)
    got = C.decode(x, blocks, 0.3)
    p, q, r = (x[:, s] @ c.T for s, c in blocks)
    score = (p[:, :, None, None] + q[:, None, :, None] + r[:, None, None, :]).reshape(20, -1) / np.sqrt(3)
    for k in range(20):
        assert got[k].tolist() == (np.flatnonzero(score[k] >= 0.3).tolist() or [int(score[k].argmax())])


def test_given_table_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 1, "", 1) for r in df.collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in C.similar_vectors(df).collect()) == sorted(want(rows).values())
    assert run(spark, []) == []


@pytest.mark.parametrize("dim", [2, 7, 16, 33, 128, 300])
def test_every_length_is_a_space_of_its_own(spark, dim):
    rnd = np.random.default_rng(dim)
    x = []
    for _ in range(20):
        c = rnd.standard_normal(dim)
        x += [c / np.linalg.norm(c) + rnd.standard_normal(dim) * rnd.choice([0.0, 0.5, 1.0, 1.5]) * 0.2 / np.sqrt(dim) for _ in range(8)]
    other = [np.append(v, 0.0) for v in x[:10]]        # equal directions, one more component
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x + other)]
    got = {r.vec_id: r for r in C.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}

    def links(vs):
        u = np.array(vs)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        return ((u @ u.T >= 0.95).sum(1) - 1).tolist()

    want = links(x) + links(other)
    assert all(got[k].n_links <= w for k, w in enumerate(want))
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(want) > 200
    assert all(got[k].component_id >= len(x) for k in range(len(x), len(rows)))


def test_double_components_are_not_narrowed(spark):
    a = [1.0, 0.0, 1e-9]
    b = [1.0, 0.0, 1e-9 + 1e-17]
    df = spark.createDataFrame([(0, a), (1, b), (2, [1e200, 0.0, 1e191])], "vec_id bigint, embedding array<double>")
    assert [r.n_links for r in C.similar_vectors(df).collect()] == [2, 2, 2]
