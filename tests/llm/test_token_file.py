import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_cases import documents, edge_docs, edge_rows, empty_docs, texts_of
from tokenizers import Tokenizer

from leakscan.llm import token_file as T

PATH = P.path("word_bpe_49k.json")


def test_elias_fano_select():
    rnd = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 1), (1, 10**9), (700, 701), (5000, 10**7), (5000, 50)):
        values = np.sort(rnd.integers(0, u, n))
        ef, at = T.EliasFano.from_bytes(b"xx" + T.EliasFano.build(values, u).to_bytes(), 2)
        assert ef.all().astype(np.int64).tolist() == values.tolist()
        for k in range(0, n, max(1, n // 300)):
            assert ef.select(k) == values[k]


def test_block_random_access():
    counts = np.array([1, 5, 0, 3, 1])
    ids = np.arange(10)
    b = T.Block(T.pack_block([None, -4, -4, 0, 9**18], counts, ids, 77, 2))
    assert b.doc_ids() == [None, -4, -4, 0, 9**18] and b.before == 77
    assert [b.document(k).tolist() for k in range(5)] == [[0], [1, 2, 3, 4, 5], [], [6, 7, 8], [9]]


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_against_library(spark, make, monkeypatch):
    df = make(spark)
    lib = Tokenizer.from_file(PATH)
    start, want = 0, []
    for d, t in sorted(texts_of(df), key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(tuple(r) for r in T.write_and_read(df, PATH, 2).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect())
    assert got == want


def test_null_ids_come_first(spark):
    rows = [(None, *edge_rows()[4][1:]), *edge_rows()[4:7]]
    got = T.write_and_read(edge_docs(spark, rows), PATH, 2).select("doc_id", "start").collect()
    assert {r.start for r in got if r.doc_id is None} == {0} and len(got) == 4
