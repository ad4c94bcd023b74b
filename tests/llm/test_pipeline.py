from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from llm_cases import SF, documents, edge_docs, empty_docs, words
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as P
from leakscan.llm import mixing, quality


def rows(df):
    return Counter(repr(r) for r in df.collect())


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_keep_is_the_verdict(spark, make):
    """The rows kept are those of the verdict, with all their columns."""
    docs = make(spark)
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}     # copies of a row are judged alike
    got = quality.keep(docs)
    assert got.columns == docs.columns
    assert rows(got) == Counter(repr(r) for r in docs.collect() if verdict[r.doc_id])


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_documents_come_as_often_as_the_mix_says(spark, make):
    docs = make(spark)
    copies: dict = {}
    for r in mixing.mix_documents(docs).collect():
        copies.setdefault((r.doc_id, r.source), []).append(r.copies)
    want: Counter = Counter()
    for r in docs.collect():
        own = copies[r.doc_id, r.source]
        times = -(-sum(own) // len(own))
        if times and words(r.text):
            want[repr(r)] += times
    got = mixing.repeat_documents(docs)
    assert got.columns == docs.columns and rows(got) == want


def test_run_is_the_stages_in_order(spark):
    """Each stage works on what its predecessor kept; ids decode to the texts of the last mix."""
    docs = documents(spark)
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        was, docs = docs, stage(spark, docs, SF)
        assert docs.columns == was.columns
        docs = P.put(docs, f"test-{name}")
        sizes.append(docs.count())
    assert 0 < sizes[2] <= sizes[1] < sizes[0] and sizes[3] == sizes[2]
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = P.run(spark, SF).collect()
    assert Counter((r.doc_id, enc.decode(list(r.ids))) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) for r in got)
