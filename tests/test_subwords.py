"""Subword ids against a plain greedy matcher."""
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leakscan.operators import subwords as S
from leakscan.plans import fixtures as FX


def greedy(vocab, text, length):
    """Every prefix of the rest is tried, longest first."""
    words = []
    for chunk in (text or "").split():
        word = ""
        for c in chunk:
            if S.is_punctuation(c):
                words += [word, c] if word else [c]
                word = ""
            elif not unicodedata.category(c).startswith("C"):
                word += c
        if word:
            words.append(word)
    ids = []
    for w in words:
        own, at = [], 0
        while at < len(w) and own is not None:
            end = next((e for e in range(min(len(w), at + 60), at, -1) if ("##" if at else "") + w[at:e] in vocab), None)
            if end is None or len(w) > S.MAX_WORD:
                own = None
            else:
                own.append(vocab[("##" if at else "") + w[at:end]])
                at = end
        ids += [vocab[S.UNKNOWN]] if own is None else own
    row = [vocab[S.CLS], *ids[:length - 2], vocab[S.SEP]]
    pad = length - len(row)
    return row + [vocab[S.PAD]] * pad, [1] * len(row) + [0] * pad, len(ids)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return S.pieces_of_byte_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_table_equals_greedy(spark, vocabulary):
    vocab = {r.piece: r.id for r in vocabulary.collect()}
    assert len(vocab) > 40000 and max(map(len, vocab)) < 140
    rows = S.subword_tokens(FX.table(spark, SF_SMALL, "documents").select("doc_id", "text"), vocabulary).collect()
    assert len(rows) == FX.table(spark, SF_SMALL, "documents").count()
    texts = {r.doc_id: r.text for r in FX.table(spark, SF_SMALL, "documents").collect()}
    for r in rows:
        assert (r.input_ids, r.attention_mask, r.n_pieces) == greedy(vocab, texts[r.doc_id], 128)


def test_edges(spark, tmp_path):
    pieces = [S.PAD, S.UNKNOWN, S.CLS, S.SEP, "un", "##aff", "##able", "aff", "a", "##b", "ab", "##bc", ",", "при", "##вет", "##a"]
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(pieces) + "\n", encoding="utf-8")
    vocabulary = S.read_vocabulary(spark, str(path))
    vocab = {r.piece: r.id for r in vocabulary.collect()}
    assert vocab == {p: i for i, p in enumerate(pieces)}
    texts = [None, "", " \n", "unaffable", "abc", "ab,a", "привет, unaffable", "xyz a", "a" * 101, "a" * 100, "a\x00b ab", "a ab\x85a", "a " * 300]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id int, text string, n_pieces string")
    got = {r.id: r for r in S.subword_tokens(df, vocabulary, length=12).collect()}
    for k, t in enumerate(texts):
        assert (got[k].input_ids, got[k].attention_mask, got[k].n_pieces) == greedy(vocab, t, 12)
    # longest match first: "abc" is ab + (no ##c) -> unknown, although a + ##bc would fit
    assert got[4].input_ids[:3] == [vocab[S.CLS], vocab[S.UNKNOWN], vocab[S.SEP]]
    assert got[3].input_ids[:5] == [vocab[S.CLS], vocab["un"], vocab["##aff"], vocab["##able"], vocab[S.SEP]]
    assert got[12].n_pieces == 300 and sum(got[12].attention_mask) == 12


def test_vocabulary_without_special_pieces_is_an_error(spark):
    with pytest.raises(ValueError, match="lacks"):
        S.subword_tokens(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([("a", 1)], "piece string, id int"))


def test_empty_table(spark, vocabulary):
    df = S.subword_tokens(spark.createDataFrame([], "text string"), vocabulary)
    assert df.count() == 0 and df.columns == ["text", "input_ids", "attention_mask", "n_pieces"]
    assert df.select(S.real_tokens(F.col("attention_mask")).alias("n")).schema["n"].dataType.simpleString() == "int"
