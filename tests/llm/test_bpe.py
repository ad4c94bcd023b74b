import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import documents, edge_docs, empty_docs, texts_of

from leakscan.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("make", [documents, edge_docs])
def test_against_library_and_round_trip(spark, library, make):
    df = make(spark)
    got = sorted(tuple(r) for r in bpe.digests(bpe.encode(df, PATH, P.PATTERN), PATH).collect())
    want = []
    for d, t in texts_of(df):
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)


def test_random_and_long_pieces(library):
    rnd = random.Random(3)
    texts = ["a" * 20000, "ab" * 3000 + "=-" * 2000, " lead", "trail ", "  two", "a\x1cb \x1c", "\x85 a"]
    texts += ["".join(rnd.choice(" \n\t\x1c\x85 ab'sté9%😀") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    enc = bpe.TextEncoder(PATH, P.PATTERN)
    flat, n = enc.encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert flat[at:at + k].tolist() == library.encode_ordinary(t)
        assert enc.bpe.decode(flat[at:at + k]) == t.encode()
        at += k


def test_keeps_other_columns_and_empty_table(spark):
    out = bpe.encode(edge_docs(spark), PATH, P.PATTERN)
    assert dict(out.dtypes)["ids"] == "array<int>" and "lang" in out.columns and "text" not in out.columns
    assert bpe.encode(empty_docs(spark), PATH, P.PATTERN).count() == 0


def test_a_task_holds_a_slice_and_leaves_no_words(library):
    import pyarrow as pa
    texts = [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(1000)] + [None, "", "w1x1"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(bpe.slices(batch))
    assert len(parts) > 2 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= bpe.GROUP_CHARS for p in parts)
    enc = bpe.TextEncoder(PATH, P.PATTERN)
    got, most = [], 0
    for out in bpe.encode_batches([batch], enc, ["doc_id"]):
        most = max(most, len(enc.words))
        got += zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), out.column("n_tokens").to_pylist())
    new = max(sum(len((t or "").split(" ")) for t in p.column("text").to_pylist()) for p in parts)
    assert 0 < most <= bpe.CACHE + new < 400 * 1000
    assert not enc.words and not enc.pieces
    want = [library.encode_ordinary(t or "") for t in texts]
    assert got == [(k, ids, len(ids)) for k, ids in enumerate(want)]


def test_words_are_learned_once_in_a_task(monkeypatch):
    """A task's distinct words may fill several slices; what was learned stays for the next ones."""
    import pyarrow as pa
    learned = []
    own = bpe.MatrixBPE.encode_pieces
    monkeypatch.setattr(bpe.MatrixBPE, "encode_pieces", lambda self, pieces: (learned.append(len(pieces)), own(self, pieces))[1])
    texts = [" ".join(f"w{k}" for k in range(lo, lo + 1000)) for lo in range(0, 150_000, 1000)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    assert len(list(bpe.slices(batch))) > 3
    out = list(bpe.encode_batches([batch], bpe.TextEncoder(PATH, P.PATTERN), ["doc_id"]))
    assert sum(b.num_rows for b in out) == len(texts) and 150_000 <= sum(learned) < 160_000


def test_cuts_beside_wide_white_space(library):
    rnd = random.Random(8)
    some = " \n\t\x1c\x85      　​ ab'sté9%😀中"
    texts = ["", " ", "　 a", "a 　", None] + ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    flat, n = bpe.TextEncoder(PATH, P.PATTERN).encode(texts)
    want = [library.encode_ordinary(t or "") for t in texts]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
