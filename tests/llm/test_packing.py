import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from llm_cases import documents, edge_docs, empty_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leakscan.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    lib = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def key(r):
    return repr(r.doc_id), r.doc_tokens


@pytest.mark.parametrize("make", [documents, edge_docs, empty_docs])
def test_every_id_once_and_no_padding(spark, make):
    df = make(spark)
    rows = packing.pack(df.repartition(3), PATH).collect()
    want = defaultdict(int)
    docs = df.select("doc_id", "text").collect()
    for r, ids in zip(docs, library_ids([d.text for d in docs])):
        want[r.doc_id, tuple(ids)] += 1
    # equal documents give equal pieces: their ids are met as often as they come
    seen = defaultdict(int)
    whole = {i: ids for i, ids in want}
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and tuple(r.ids) == ids[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        for k in range(r.start, r.start + r.length):
            seen[r.doc_id, k] += 1
    assert seen == {(i, k): n for (i, ids), n in want.items() for k in range(len(ids))}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for s in sorted(by):
        at = 0
        for o, n in sorted(by[s]):
            assert o == at
            at += n
        sizes.append(at)
    assert sorted(by) == list(range(len(by)))
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sizes == [1024] * (total // 1024) + [1 << k for k in range(10, -1, -1) if total % 1024 >> k & 1]


def literal_round_robin(queues, weights, window, packet):
    """Visits in turn: the quantum is added to the deficit, packets go while the next one fits."""
    total = sum(weights.values())
    waiting = {s: [(d, lo, min(packet, n - lo)) for d, n in q for lo in range(0, n, packet)] for s, q in queues.items()}
    deficit = dict.fromkeys(queues, Fraction(0))
    stream, rnd = [], 0
    while any(waiting.values()):
        rnd += 1
        for s in sorted(queues, key=lambda s: (s is not None, s or "")):
            deficit[s] += Fraction(window * weights[s], total)
            while waiting[s] and waiting[s][0][2] <= deficit[s]:
                d, lo, n = waiting[s].pop(0)
                deficit[s] -= n
                stream += [(d, k, rnd) for k in range(lo, lo + n)]
    return stream


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}])
def test_equals_a_literal_deficit_round_robin(spark, weights):
    rows = [(k, "word " * (7 * k % 53) + "x", [None, "a", "b", "c"][k % 4 if k % 3 else 1]) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    window, packet = 200, 16
    got = packing.pack(df, PATH, weights=weights, sequence=64, window=window, packet=packet).collect()
    ids = library_ids([r[1] for r in rows])
    queues, tokens = defaultdict(list), defaultdict(int)
    for r, x in zip(rows, ids):
        queues[r[2]].append((r[0], len(x)))
        tokens[r[2]] += len(x)
    w = tokens if weights is None else {s: weights.get(s, 1) for s in queues}
    want = literal_round_robin(queues, w, window, packet)
    place = []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        place += [(r.doc_id, k, r.window) for k in range(r.start, r.start + r.length)]
    assert place == want


def test_windows_hold_the_target_shares(spark):
    df = documents(spark).repartition(4)
    window, packet = 16384, 256
    rows = packing.pack(df, PATH, window=window, packet=packet).groupBy("window", "source").agg(F.sum("length").alias("n")).collect()
    by, last = defaultdict(int), max(r.window for r in rows)
    for r in rows:
        by[r.source] += r.n
    total = sum(by.values())
    for s, n in by.items():
        sent = 0
        for w in range(1, last + 1):
            sent += sum(r.n for r in rows if r.window == w and r.source == s)
            assert 0 <= Fraction(w * window * n, total) - sent < packet or sent == n


def test_partitions_do_not_change_what_is_packed(spark):
    df = documents(spark)
    a = packing.pack(df.repartition(2), PATH).groupBy("doc_id").agg(F.sum("length").alias("n"))
    b = packing.pack(df.repartition(7), PATH).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sequences_from_pieces(spark):
    pieces = packing.pack(edge_docs(spark), PATH)
    got = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for s, ids in got.items():
        assert len(ids) & (len(ids) - 1) == 0 and len(ids) <= 1024
    rows = pieces.collect()
    for r in rows:
        assert got[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_uneven_texts_are_encoded_as_the_library_does():
    import pyarrow as pa
    texts = ["a b", " a b", "a  b", "a b ", "", "a\n b", "a \tb", "x  y", "x   y", "don't <|endoftext|> stop<|endoftext|> ", "<|endoftext|>", "é ñ 日本 語", "a \x1cb", "\x01 b"] * 3
    flat, n = packing._encoder(PATH).encode(pa.array(texts))
    want = [ids[:-1] for ids in library_ids(texts)]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
