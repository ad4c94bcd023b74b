from collections import Counter, defaultdict

import pytest
from llm_cases import documents, edge_docs, empty_docs, words

from leakscan.llm import mixing


def level(sizes, weights, total, epochs=3):
    """Targets by pouring again and again."""
    t, full = {}, set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        t = {s: epochs * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and t[s] > epochs * sizes[s]}
        if not over:
            return t
        full |= over
        if len(full) == len(sizes):
            return {s: epochs * sizes[s] for s in sizes}


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_mix(spark, make):
    df = make(spark)
    rows = mixing.mix_documents(df).collect()
    again = mixing.mix_documents(df.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    docs = df.select("doc_id", "source", "text").collect()
    assert Counter((d.doc_id, len(words(d.text))) for d in docs) == Counter((r.doc_id, r["size"]) for r in rows)
    size = defaultdict(int)
    for d in docs:
        size[d.source] += len(words(d.text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    if order:
        want = level(size, {s: 1 + k % 3 for k, s in enumerate(order)}, sum(size.values()))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 260 + 0.01 * want[s]


def test_schedule_is_whole_and_even(spark):
    df = spark.createDataFrame([(k, "w " * 500, f"s{k % 4}") for k in range(200)], "doc_id bigint, text string, source string")
    per = mixing.targets(mixing.sizes(df))
    quota = {r.source_no: r.quota for r in per.collect()}
    slots = mixing.schedule(per).collect()
    ranks = defaultdict(list)
    for s in slots:
        ranks[s.source_no].append(s["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(q)) for k, q in quota.items()}
    first = Counter(s.source_no for s in slots if s.slot is not None and s.slot < 100)
    total = sum(quota.values())
    assert all(abs(first[k] - 100 * q / total) < 4 for k, q in quota.items())


def test_rows_of_one_id_lie_in_many_buckets(spark):
    df = spark.createDataFrame([(None if k % 2 else 7, "w " * (1 + k % 50) + str(k), "s") for k in range(2000)], "doc_id bigint, text string, source string")
    mix = mixing.Mix(bucket_rows=100)
    sized = mixing.sizes(df)
    laid = mixing.blocks(sized, mixing.targets(sized, mix), mix)
    assert laid.select("h").distinct().count() == 2000
    words = sorted((r.first_word, r["size"]) for r in laid.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(words, words[1:]))


def test_repeat_documents_takes_copies_by_the_blocks(spark):
    df = spark.createDataFrame([(k, "w " * 300, f"s{k % 3}", k) for k in range(90)] + [(900, None, "s0", 0), (901, " ", "s1", 0)],
                               "doc_id bigint, text string, source string, copies bigint")
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(df.drop("copies")).collect()}
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({d: n for d, n in copies.items() if n}) and 900 not in got and 901 not in got
