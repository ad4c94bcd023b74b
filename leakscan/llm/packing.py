"""Packing documents into full sequences by deficit round-robin over source queues.

The documents of a source, in the order in which they are stored, are its queue, cut
into packets of at most ``PACKET`` tokens. Rounds go over the queues in turn: a visit adds
the source's quantum (its target share of a window of ``WINDOW`` tokens, an exact fraction)
to its deficit and sends packets while the next one fits; what is left stays for the
next round. So each round fills one window, in which no source is further than a packet from its
target, nor in all windows up to it together. The stream of windows is cut into sequences of 1024 tokens; the last
tokens, less than 1024, are cut into sequences whose lengths are falling powers of
two, so nothing is padded at all.

After round r a source has sent the longest prefix of its queue that r quanta hold. The
round of a packet therefore follows from its place in the queue alone: tasks need the tokens
that other tasks put into the queue before them, and nothing else, to carry all deficits on across
windows and partitions (``tests/llm`` compares this with a literal round-robin).

On Spark: one pass encodes the texts and writes ids, with the place in the queue of
the task; sums by (task, source) give the places in the whole queue; sums by round give the
place of each window in the stream; segments (the packets of a document in one round) meet
by round, a bounded group of about ``WINDOW`` tokens, where a running sum gives their places. Only two numbers
(all tokens, the sum of the weights) reach the driver.

Defined results: a null text is empty and holds the end id alone; null is a source of
its own, first in turn; a null doc_id is kept; repeated rows are packed each on its own; an
empty table gives no rows; extra columns are ignored. A document is cut where a packet, a window or a sequence ends.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import IdTable, sums
from .common import put, ship
from .word_ids import numbered, slices, texts_of

SEQUENCE = 1024
PACKET = 1024
WINDOW = 64 * SEQUENCE
CACHE = 500_000
GROUP_BYTES = 4_000_000
JOIN = 100
#: Rounds whose places are summed in one task; the sums of such blocks are the second level.
ROUND_BLOCK = 4096
#: A space beside other white space, or at an end: the units of such texts are not cut at spaces.
_WS = r"[\s\v\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNEVEN = f"^ | $| {_WS}|{_WS} "


class UnitEncoder:
    """Texts to ids with the tokenizers library for byte-level vocabularies. Their pattern always cuts at
    a space between visible characters, so each distinct word with its space is encoded once."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.table = IdTable()
        # a token that starts with a space starts a unit
        self.starts = np.array([(self.lib.id_to_token(i) or "").startswith("Ġ") for i in range(self.size)])

    def _units(self, units: list):
        """As ``_ids`` of units with one space in front: many go in one string, which takes less time."""
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        joined = ["".join(units[k:k + JOIN]) for k in range(0, len(units), JOIN)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)])
        return np.diff(np.flatnonzero(self.starts[flat]), append=len(flat)), flat

    def _ids(self, texts: list):
        got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter((i for ids in got for i in ids), np.int32, int(n.sum()))

    def _even(self, col):
        if not len(col):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, distinct, counts = numbered(pc.split_pattern(col, " "))
        form = 2 * word + 1
        form[np.cumsum(counts) - counts] -= 1
        used = np.flatnonzero(np.bincount(form, minlength=2 * len(distinct)))
        if len(self.table) > CACHE:
            self.table.clear()
        number = np.zeros(2 * len(distinct), np.int64)
        for first, front, ids_of in ((0, "", self._ids), (1, " ", self._units)):
            forms = used[(used & 1) == first]
            number[forms] = self.table.numbers([front + w for w in distinct.take(pa.array(forms >> 1)).to_pylist()])
            if self.table.new:
                self.table.add(*ids_of(self.table.new))
        flat, n = self.table.gather(number[form])
        return flat, sums(n, counts)

    def encode(self, col: pa.Array):
        """All ids of the texts, one after the other, and the count of each text."""
        uneven = pc.match_substring_regex(col, UNEVEN)
        flat, n = self._even(col.filter(pc.invert(uneven)))
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if not len(odd):
            return flat, n
        n_odd, flat_odd = self._ids(col.filter(uneven).to_pylist())
        counts = np.zeros(len(col), np.int64)
        is_odd = np.zeros(len(col), bool)
        is_odd[odd] = True
        counts[~is_odd], counts[is_odd] = n, n_odd
        mine = np.repeat(is_odd, counts)
        out = np.empty(int(counts.sum()), np.int32)
        out[~mine], out[mine] = flat, flat_odd
        return out, counts


_ENCODERS: dict = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _binaries(flat: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(counts) * width])
    data = pa.py_buffer(np.ascontiguousarray(flat.astype(f"<u{width}")).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), data]).cast(pa.binary())


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> tuple[DataFrame, int]:
    """Written table shard, doc_id, source, before (tokens of the source earlier in the shard),
    n, ids (little-endian, of the width that is returned, too)."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(_encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4

    def run(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        enc = _encoder(tokenizer)
        sent: dict = {}
        for b in batches:
            col = texts_of(b.column("text"))
            for lo, hi in slices(col, GROUP_BYTES):
                flat, n = enc.encode(col.slice(lo, hi - lo))
                flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                sources = b.column("source").slice(lo, hi - lo)
                before = []
                for s, k in zip(sources.to_pylist(), n.tolist()):
                    before.append(sent.get(s, 0))
                    sent[s] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * (hi - lo), pa.int32()), b.column("doc_id").slice(lo, hi - lo), sources,
                     pa.array(before, pa.int64()), pa.array(n), _binaries(flat, n, width)],
                    names=["shard", "doc_id", "source", "before", "n", "ids"])

    d = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text")
    out = d.mapInArrow(run, "shard int, doc_id bigint, source string, before bigint, n bigint, ids binary")
    return put(out, "packing-ids"), width


def _queues(encoded: DataFrame, weights: dict | None) -> tuple[DataFrame, int, int]:
    """(shard, source) -> base (tokens of the source in earlier shards) and weight; all tokens and
    the sum of the weights. A row per task and source."""
    own = encoded.groupBy("shard", "source").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source")
    weight = F.sum("n").over(w) if weights is None else F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in (weights or {"": 1}).items() for x in kv]), F.coalesce("source", F.lit(""))).cast("bigint"), F.lit(1))
    q = put(own.select("shard", F.col("source").alias("of"), "n", weight.cast("bigint").alias("weight"),
                       (F.sum("n").over(w.orderBy("shard")) - F.col("n")).alias("base")), "packing-queues")
    total = q.agg(F.sum("n")).first()[0] or 0
    share = q.groupBy("of").agg(F.first("weight").alias("w")).agg(F.sum("w")).first()[0] or 1
    return q, total, share


def round_of(end: int, weight: int, weights: int, window: int) -> int:
    """The round (1, 2, ...) that sends the packet which ends at ``end`` of its queue: the first r
    with r * window * weight / weights >= end."""
    return -(-end * weights // (window * weight))


def _segments(encoded: DataFrame, queues: DataFrame, weights: int, window: int, packet: int, width: int, with_ids: bool) -> DataFrame:
    """round, source, queue (place in it), length and, with ids, doc_id, start, doc_tokens, ids of
    the tokens that a document sends in one round."""
    cols = ["source", "base", "weight", "before", "n"] + (["doc_id", "ids"] if with_ids else [])
    of = queues.select(F.col("shard").alias("at"), "of", "weight", "base")
    rows = encoded.join(of, (F.col("shard") == F.col("at")) & F.col("source").eqNullSafe(F.col("of"))).select(*cols)
    schema = "round bigint, source string, queue bigint, length bigint" + (", doc_id bigint, start bigint, doc_tokens bigint, ids binary" if with_ids else "")

    def run(batches):
        for b in batches:
            row, start, length, rnd = [], [], [], []
            base = (b.column("base").to_numpy() + b.column("before").to_numpy()).tolist()
            counts = b.column("n").to_pylist()
            for k, (q, n, w) in enumerate(zip(base, counts, b.column("weight").to_pylist())):
                lo, now = 0, None
                for end in range(packet, n + packet, packet):
                    r = round_of(q + min(n, end), w, weights, window)
                    if now is not None and r != now:
                        row.append(k)
                        start.append(lo)
                        length.append(end - packet - lo)
                        rnd.append(now)
                        lo = end - packet
                    now = r
                row.append(k)
                start.append(lo)
                length.append(n - lo)
                rnd.append(now)
            take = pa.array(row, pa.int64())
            at = np.array(start, np.int64)
            out = {"round": pa.array(rnd, pa.int64()), "source": b.column("source").take(take),
                   "queue": pa.array(np.array(base, np.int64)[row] + at if row else at), "length": pa.array(length, pa.int64())}
            if with_ids:
                ids = b.column("ids")
                parts = [ids[k].as_buffer()[width * s:width * (s + n)].to_pybytes() for k, s, n in zip(row, start, length)]
                out |= {"doc_id": b.column("doc_id").take(take), "start": pa.array(at), "doc_tokens": b.column("n").take(take),
                        "ids": pa.array(parts, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, schema)


def _window_places(lengths: DataFrame) -> DataFrame:
    """round -> at (tokens of all earlier rounds). Two levels: running sums within blocks of
    rounds, and over one row a block."""
    r = lengths.groupBy("round").agg(F.sum("length").alias("n")).withColumn("block", F.expr(f"round div {ROUND_BLOCK}"))
    r = put(r, "packing-rounds")
    blocks = r.groupBy("block").agg(F.sum("n").alias("bn")).select(
        "block", (F.sum("bn").over(Window.orderBy("block")) - F.col("bn")).alias("block_at"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("round")) - F.col("n")
    return r.withColumn("inside", inside).join(blocks, "block").select("round", (F.col("block_at") + F.col("inside")).alias("at"))


def edges_of(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Ends of the sequences behind the full ones, as places in the stream: falling powers of two."""
    full = total // sequence * sequence
    out, at = [], full
    for k in range(total.bit_length(), -1, -1):
        if (total - full) >> k & 1:
            at += 1 << k
            out.append(at)
    return out


def cut(place: int, length: int, total: int, tail: list[int], sequence: int = SEQUENCE):
    """(sequence, offset, place in the segment, length) of the pieces of tokens ``place`` .. ``place + length``."""
    full = total // sequence
    at, end = place, place + length
    while at < end:
        if at < full * sequence:
            seq, lo = at // sequence, at // sequence * sequence
            hi = lo + sequence
        else:
            k = next(i for i, e in enumerate(tail) if at < e)
            seq, lo, hi = full + k, tail[k - 1] if k else full * sequence, tail[k]
        stop = min(end, hi)
        yield seq, at - lo, at - place, stop - at
        at = stop


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, weights: dict | None = None,
         sequence: int = SEQUENCE, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (array of int), ids_crc32, doc_tokens,
    sequence_id, offset, window, source. ``weights``: source -> positive integer (others 1); by
    default a source's tokens, so that all queues last to the end."""
    encoded, width = encode(docs, tokenizer, end_id)
    queues, total, share = _queues(encoded, weights)
    places = put(_window_places(_segments(encoded, queues, share, window, packet, width, False)), "packing-places")
    placed = _segments(encoded, queues, share, window, packet, width, True).join(places, "round")
    turn = Window.partitionBy("round").orderBy(F.col("source").asc_nulls_first(), "queue")
    placed = placed.withColumn("place", F.col("at") + F.sum("length").over(turn) - F.col("length"))
    tail = edges_of(total, sequence)

    def run(batches):
        for b in batches:
            row, seq, offset, inner, length, crc, parts = [], [], [], [], [], [], []
            ids = b.column("ids")
            for k, (p, n) in enumerate(zip(b.column("place").to_pylist(), b.column("length").to_pylist())):
                own = np.frombuffer(ids[k].as_buffer(), f"<u{width}").astype("<u4")
                for s, o, i, m in cut(p, n, total, tail, sequence):
                    row.append(k)
                    seq.append(s)
                    offset.append(o)
                    inner.append(i)
                    length.append(m)
                    parts.append(own[i:i + m])
                    crc.append(zlib.crc32(parts[-1].tobytes()))
            take = pa.array(row, pa.int64())
            offs = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            flat = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), pc.add(b.column("start").take(take), pa.array(inner, pa.int64())), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(offs, pa.array(flat)), pa.array(crc, pa.int64()), b.column("doc_tokens").take(take),
                 pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), b.column("round").take(take), b.column("source").take(take)],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source"])

    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", "place", "round", "source").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, "
             "sequence_id bigint, offset bigint, window bigint, source string")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids of whole sequences (groups of at most ``SEQUENCE`` tokens)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
