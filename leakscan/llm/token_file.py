"""Token-ID files with Elias-Fano document boundaries.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its range and
writes blocks of about ``BLOCK_IDS`` ids. A block is one byte string: a header, the
document ends and the document ids as two Elias-Fano sequences, and the concatenated ids
(2 bytes each if the vocabulary allows, else 4). An Elias-Fano sequence of n values below
u takes about n * (2 + log2(u / n)) bits: low bits packed, high bits unary, with a sampled
directory for select; no table of 64-bit offsets is kept. Blocks travel in Parquet rows
``(shard, block, n_docs, n_ids, data)``, so Spark's commit protocol and readers handle
the files wherever they lie. A block knows how many ids its shard has before it; only the
totals of the shards (one short row per write task) are joined on reading.

Defined results: null texts are empty and hold the end id alone; rows with a null
doc_id come first; equal doc_ids stay together, in the order of their text's hash;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .bpe import IdTable, sums
from .common import ship
from .word_ids import slices, words

BLOCK_IDS = 1 << 18
CACHE = 900_000
SAMPLE = 256
MARK = "\x01"
JOIN = 100
GROUP_BYTES = 4_000_000
MAGIC = b"EFTB"
HEAD = struct.Struct("<4sHHIIQQqQQ")
SEQ = struct.Struct("<IBQII")


class EliasFano:
    """Non-decreasing values below ``u`` with select."""

    def __init__(self, n, low_bits, u, low, high, directory):
        self.n, self.low_bits, self.u, self.low, self.high, self.directory = n, low_bits, u, low, high, directory

    @classmethod
    def build(cls, values, u: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(u // max(n, 1)).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, u, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (SEQ.pack(self.n, self.low_bits, self.u, len(self.low), len(self.high)) + self.low.tobytes()
                + self.high.tobytes() + self.directory.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, u, a, b = SEQ.unpack_from(data, at)
        at += SEQ.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        k = -(-n // SAMPLE)
        return cls(n, low_bits, u, low, high, np.frombuffer(data, "<u4", k, at + a + b)), at + a + b + 4 * k

    def _low(self, k):
        at = np.arange(self.low_bits) + np.asarray(k)[:, None] * self.low_bits
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, k: int) -> int:
        """The k-th value: from the nearest sample on, whole bytes are skipped by their popcount."""
        at, left = int(self.directory[k // SAMPLE]), k % SAMPLE
        byte, keep = at >> 3, 0xFF << (at & 7) & 0xFF
        while True:
            v = int(self.high[byte]) & keep
            if v.bit_count() > left:
                break
            left -= v.bit_count()
            byte, keep = byte + 1, 0xFF
        for _ in range(left):
            v &= v - 1
        one = byte * 8 + (v & -v).bit_length() - 1
        return ((one - k) << self.low_bits) | int(self._low([k])[0])

    def all(self):
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(np.arange(self.n))


def pack_block(doc_ids: list, counts, ids, before: int, width: int) -> bytes:
    """``doc_ids`` ascending, nulls first; ``before``: ids of the shard's earlier blocks."""
    nulls = sum(d is None for d in doc_ids)
    own = np.array(doc_ids[nulls:], np.int64)
    first = int(own[0]) if len(own) else 0
    deltas = own.astype(object) - first if len(own) else np.zeros(0, np.int64)
    deltas = np.array([int(d) for d in deltas], np.uint64)
    span = int(deltas[-1]) + 1 if len(own) else 1
    ends = EliasFano.build(np.cumsum(counts), int(np.sum(counts)) + 1)
    return (HEAD.pack(MAGIC, 1, width, len(doc_ids), nulls, len(ids), before, first, span, 0)
            + ends.to_bytes() + EliasFano.build(deltas, span).to_bytes() + np.asarray(ids).astype(f"<u{width}").tobytes())


class Block:
    """A packed block, read back."""

    def __init__(self, data: bytes):
        magic, version, width, self.n_docs, self.nulls, self.n_ids, self.before, self.first, _, _ = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        self.ends, at = EliasFano.from_bytes(data, HEAD.size)
        self.deltas, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def document(self, k: int):
        """Ids of the k-th document, by two selects."""
        return self.ids[self.ends.select(k - 1) if k else 0:self.ends.select(k)]

    def doc_ids(self) -> list:
        return [None] * self.nulls + [self.first + int(d) for d in self.deltas.all()]


class WordEncoder:
    """Texts to ids with the tokenizers library. Its word vocabularies drop white space and
    never merge across it, so each distinct word between ASCII spaces is encoded once."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.words = IdTable()
        self.mark = self.lib.encode(MARK, add_special_tokens=False).ids

    def _library(self, new: list):
        """Ids of words, as (counts, all ids). Many go in one string, each with the mark behind it,
        between spaces a symbol of its own; one call per word takes longer."""
        if len(self.mark) != 1 or any(MARK in w for w in new):
            got = [e.ids for e in self.lib.encode_batch_fast(new, add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            return n, np.fromiter((i for ids in got for i in ids), np.int32, int(n.sum()))
        joined = [f" {MARK} ".join(new[k:k + JOIN]) + f" {MARK}" for k in range(0, len(new), JOIN)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark[0])
        return np.diff(ends, prepend=-1) - 1, np.delete(flat, ends)

    def encode(self, col):
        """All ids of a text column, one text after the other, and the count of each text."""
        if len(self.words) > CACHE:
            self.words.clear()
        word, distinct, counts = words(col)
        number = self.words.numbers(distinct.to_pylist())
        if self.words.new:
            self.words.add(*self._library(self.words.new))
        flat, n = self.words.gather(number[word])
        return flat, sums(n, counts)


_ENCODERS: dict = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``."""
    import pyarrow as pa
    spark = docs.sparkSession
    ship(spark)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    names = ["shard", "block", "n_docs", "n_ids", "data"]

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        enc = _encoder(tokenizer)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        block, before, held = 0, 0, []

        def row():
            nonlocal block, before
            ids = np.concatenate([h[2] for h in held])
            counts = np.concatenate([h[1] for h in held])
            data = pack_block([d for h in held for d in h[0]], counts, ids, before, width)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([len(counts)], pa.int64()),
                                              pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=names)
            block, before = block + 1, before + len(ids)
            held.clear()
            return out

        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id").to_pylist()
            for lo, hi in slices(texts, GROUP_BYTES):
                flat, n = enc.encode(texts.slice(lo, hi - lo))
                held.append((doc_ids[lo:hi], n + 1, np.insert(flat, np.cumsum(n), end_id)))
                if sum(len(h[2]) for h in held) >= BLOCK_IDS:
                    yield row()
        if held:
            yield row()

    # row groups of a few blocks: a reading task holds no more than that
    dealt.mapInArrow(run, "shard int, block bigint, n_docs bigint, n_ids bigint, data binary").write.option(
        "parquet.block.size", 8 << 20).parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int) of every
    document, from the blocks."""
    import pyarrow as pa
    ship(spark)
    blocks = spark.read.parquet(path)
    # one row per write task: the window's single task and the broadcast are bounded by their number
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "shard_start")

    def run(batches):
        for b in batches:
            for data, base in zip(b.column("data"), b.column("shard_start").to_pylist()):
                k = Block(data.as_py())
                ends = k.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = k.ids.astype("<u4")
                raw = memoryview(wide.tobytes())
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                cols = {"doc_id": pa.array(k.doc_ids(), pa.int64()), "start": pa.array(base + k.before + starts),
                        "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return blocks.join(F.broadcast(shards), "shard").select("data", "shard_start").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    path = scratch_path(docs.sparkSession, f"llm-tokens-{uuid.uuid4().hex}")
    write(docs, tokenizer, end_id, path)
    return read(docs.sparkSession, path, with_ids)
