"""Byte-level BPE encoding and decoding with numpy matrices.

The merge ranks become a hashed table of pairs (open addressing, linear probing). The
distinct pieces of a batch are put into matrices by length bucket, padded with -1. Each
round, every row merges its leftmost pair of minimum rank, found by a row-wise arg-min
over the rank matrix; rows without a pair leave the matrix (compaction), the others
are one symbol shorter, so the matrix gets narrower with each round. Pieces beyond
``LONG`` bytes merge all occurrences of their minimum pair in a round where that gives
the same ids (checked on the table for each token; otherwise one at a time).

Texts are cut at single spaces between visible characters, where the piece pattern always
cuts too, so that repeated words are found in a table instead of being matched again. Cuts are
made over the bytes of a whole slice; its distinct words and those of the table meet in Arrow's
kernels, so that Python sees new words alone.

Defined results: a null text is an empty one and has no ids; decoding gives back the
exact UTF-8 bytes; repeated rows are encoded alike. Other columns are kept as they are,
but for input columns called ``ids`` or ``n_tokens``, which are replaced.
Work is map-only; memory is bounded by a batch, of which a slice is worked on at a time, and the
word table (``CACHE`` entries, ``CACHE_BYTES`` of words), which is emptied with its task: the worker waits on beside the next stage.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .word_ids import texts_of

NONE = np.int64(1 << 62)
LONG = 512
CELLS = 1 << 19
CACHE = 250_000
CACHE_BYTES = 1 << 24
GROUP_CHARS = 1_000_000
DIGEST_IDS = 500_000
#: White space by first byte, and the characters beyond ASCII as numbers of their two or three bytes.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if c.isspace()])
_WIDE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, left, right, merged):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(3 * len(keys) + 1))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << self.bits, NONE)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.keys[slot[win]], self.vals[slot[win]] = keys[todo[win]], np.asarray(merged, np.int64)[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, slot = todo[rest], (slot[rest] + np.uint64(1)) & self.mask

    def _slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, left, right):
        """Merged ids, NONE where the pair doesn't merge; negative ids are padding."""
        bad = (left < 0) | (right < 0)
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.vals[slot], NONE)
        todo = np.flatnonzero((got != keys) & (got != np.uint64(2**64 - 1)))
        flat, keys, slot = out.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        at = slot[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + np.uint64(1)) & self.mask
            got = self.keys[at]
            hit = got == keys[todo]
            flat[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (got != np.uint64(2**64 - 1))
            todo, at = todo[go], at[go]
        out = flat.reshape(left.shape)
        out[bad] = NONE
        return out


class MatrixBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.table = PairTable(left, right, merged)
        # a token is calm if no pair with it merges to a lower rank than its own: then merging
        # all its occurrences at once gives what merging them one by one gives
        low = np.full(max(ranks.values()) + 1, NONE)
        np.minimum.at(low, left, merged)
        np.minimum.at(low, right, merged)
        self.calm = low > np.arange(len(low))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        n = max(ranks.values()) + 1
        by_id = [b""] * n
        for token, rank in ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.binary())
        self.digits = pa.array([b"%d " % k for k in range(n)], pa.binary())
        self.lens = np.array([len(t) for t in by_id], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

    def _long(self, ids):
        """One long piece: all occurrences of the minimum pair a round, leftmost first."""
        while len(ids) > 1:
            ranks = self.table.find(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            if self.calm[low]:
                run = np.concatenate([[True], np.diff(at) > 1])
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            else:
                at = at[:1]
            ids = ids.copy()
            ids[at] = low
            ids = np.delete(ids, at + 1)
        return ids

    def _bucket(self, m):
        """(rows, number of ids of each, their ids one after the other) of a padded matrix, in parts."""
        rows = np.arange(len(m))
        out = []
        ranks = self.table.find(m[:, :-1], m[:, 1:])
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                d = m[done]
                real = d >= 0
                out.append((rows[done], real.sum(1), d[real]))
                go = ~done
                rows, m, ranks, at, low = rows[go], m[go], ranks[go], at[go], low[go]
                if not len(rows):
                    return out
            k = np.arange(len(rows))
            m[k, at] = low
            cols = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols > at[:, None]), 1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            for shift in (-1, 0):
                c = at + shift
                ok = (c >= 0) & (c < ranks.shape[1])
                if ok.any():
                    ranks[k[ok], c[ok]] = self.table.find(m[k[ok], c[ok]], m[k[ok], c[ok] + 1])

    def encode_pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece (merges never cross pieces)."""
        data, ends = _bytes(pieces)
        lens = np.diff(ends)
        width = np.where(lens <= 2, 2, 1 << np.ceil(np.log2(np.maximum(lens, 2))).astype(np.int64))
        got = []
        for k in np.flatnonzero(lens > LONG).tolist():
            ids = self._long(self.byte_ids[data[ends[k]:ends[k + 1]]])
            got.append((np.array([k]), np.array([len(ids)]), ids))
        for w in np.unique(width[lens <= LONG]).tolist():
            which = np.flatnonzero((width == w) & (lens <= LONG))
            for lo in range(0, len(which), max(1, CELLS // w)):
                part = which[lo:lo + max(1, CELLS // w)]
                n = lens[part]
                m = np.full((len(part), w), -1, np.int64)
                m[np.arange(w) < n[:, None]] = self.byte_ids[_bytes(pieces.take(pa.array(part)))[0]]
                got += [(part[rows], *ids) for rows, *ids in self._bucket(m)]
        if not got:
            return _lists(np.zeros(0, np.int64), np.zeros(0, np.int32))
        which, n, flat = (np.concatenate(x) for x in zip(*got))
        return _lists(n, flat).take(pa.array(np.argsort(which)))

    def decode(self, ids) -> bytes:
        """The bytes of an id array."""
        ids = np.asarray(ids, np.int64)
        n = self.lens[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return b""
        return self.blob[np.repeat(self.offs[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class IdTable(dict):
    """Key -> number, in order of first sight, and the ids of each key, one after the other.
    ``new`` lists the keys whose ids are still to be added."""

    def __init__(self):
        self.clear()

    def clear(self):
        super().clear()
        self.new: list = []
        self.counts = np.zeros(0, np.int64)
        self.offs = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list):
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def add(self, counts, flat):
        """Ids of the keys in ``new``."""
        ends = np.cumsum(counts)
        self.offs = np.concatenate([self.offs, len(self.flat) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.asarray(flat, np.int32)])
        self.new = []

    def gather(self, numbers):
        """All ids of these keys, and the count of each."""
        n = self.counts[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offs[numbers] - (ends - n), n) + np.arange(total)], n


def sums(values, counts):
    """Sums of consecutive runs of ``values``, ``counts`` long."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


def _bytes(col: pa.Array):
    """(bytes, offsets into them) of a text or binary column without nulls."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


def _lists(counts, flat) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(np.asarray(flat, np.int32)))


def _blank(data):
    """Whether each byte belongs to a white space character."""
    out = _BLANK[data]
    at = np.flatnonzero(_WIDE_LEADS[data])
    if len(at):
        first, second, third = (np.append(data, np.zeros(2, np.uint8))[at + k].astype(np.int64) for k in range(3))
        two = first << 8 | second
        short, long = at[np.isin(two, _WIDE)], at[np.isin(two << 8 | third, _WIDE)]
        for k, which in enumerate((np.append(short, long), np.append(short, long), long)):
            out[which + k] = True
    return out


def _units(col: pa.Array):
    """(units, their number per text): the texts cut at single spaces between visible characters,
    which stay in front of what follows."""
    data, ends = _bytes(col)
    blank = _blank(data)
    cut = data == 32
    cut[1:] &= ~blank[:-1]
    cut[:-1] &= ~blank[1:]
    cut[ends[:-1][ends[1:] > ends[:-1]]] = True
    starts = np.flatnonzero(cut)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    return units, np.diff(np.searchsorted(starts, ends))


class IdLists:
    """The ids of distinct texts, as Arrow columns."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def __len__(self):
        return len(self.keys)

    def full(self):
        return len(self) > CACHE or self.keys.nbytes > CACHE_BYTES

    def find(self, col: pa.Array, learn) -> pa.ListArray:
        """The ids of each row; ``learn`` gives those of distinct rows that are new."""
        coded = col.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        if at.null_count:
            new = coded.dictionary.filter(pc.is_null(at))
            at = at.to_numpy(zero_copy_only=False)
            at = np.where(np.isnan(at), len(self) - 1 + np.cumsum(np.isnan(at)), at).astype(np.int64)
            ids = learn(new)
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.ids, ids])
        else:
            at = at.to_numpy(zero_copy_only=False)
        return self.ids.take(pa.array(at[coded.indices.to_numpy(zero_copy_only=False)]))


class TextEncoder:
    """Whole texts to ids: pieces by pattern, distinct pieces through the matrices."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.bpe = MatrixBPE(load_ranks(path))
        # White space as the rank files' own library understands it
        self.piece = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.words, self.pieces = IdLists(), IdLists()

    def _learn(self, new: pa.Array) -> pa.ListArray:
        """Ids of new words, by their pieces."""
        # words with one space in front cut each other off when joined; the others go one by one
        data, ends = _bytes(new)
        blank, first, size = _blank(data), ends[:-1], np.diff(ends)
        joined = (size > 1) & (data[first] == 32) & ~blank[np.minimum(first + 1, len(data) - 1)] & ~blank[ends[1:] - 1]
        together = new.filter(pa.array(joined))
        data, ends = _bytes(together)
        cut = pa.array(self.piece.findall(data.tobytes().decode("utf-8")), pa.string())
        alone = np.flatnonzero(~joined)
        own = [self.piece.findall(w) for w in new.take(pa.array(alone)).to_pylist()]
        counts = np.append(np.diff(np.searchsorted(_bytes(cut)[1], ends)), np.array([len(ps) for ps in own], np.int64))
        ids = self.pieces.find(pa.concat_arrays([cut, pa.array([p for ps in own for p in ps], pa.string())]), self.bpe.encode_pieces)
        n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return _lists(sums(n, counts), ids.flatten()).take(pa.array(np.argsort(np.append(np.flatnonzero(joined), alone))))

    def encode(self, texts):
        """All ids of the texts, one after the other, and the count of each text."""
        for t in (self.words, self.pieces):
            if t.full():
                t.clear()
        units, counts = _units(texts_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
        ids = self.words.find(units, self._learn)
        n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return ids.flatten().to_numpy(zero_copy_only=False), sums(n, counts)

    def forget(self):
        """Empty the tables of words and pieces; the merges stay."""
        self.words.clear()
        self.pieces.clear()
        pa.default_memory_pool().release_unused()


_ENCODERS: dict = {}
_MERGES: dict = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder a worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def groups(texts: list, chars: int = GROUP_CHARS):
    """Consecutive slices of about ``chars`` characters, one text at least."""
    lo, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield lo, k + 1
            lo, n = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def slices(batch, size: int = GROUP_CHARS):
    """Consecutive slices of a record batch with about ``size`` bytes of ``text``, one row at least."""
    for lo, hi in _ranges(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), size):
        yield batch.slice(lo, hi - lo)


def encode_batches(batches, enc: TextEncoder, rest: list[str]):
    """Record batches with the columns ``rest``, ``ids`` and ``n_tokens``, a slice at a time."""
    for b in (part for whole in batches for part in slices(whole)):
        flat, n = enc.encode(b.column("text"))
        offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in rest], pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array(n)],
            names=[*rest, "ids", "n_tokens"])
    enc.forget()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` instead of ``text``."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    schema = docs.select(*[f"`{c}`" for c in rest]).withColumns({
        "ids": F.array().cast("array<int>"), "n_tokens": F.lit(0).cast("bigint")}).schema

    def run(batches):
        return encode_batches(batches, encoder(path, pattern), rest)

    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, schema)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(encoded.sparkSession)

    def run(batches):
        bpe = None
        for b in batches:
            if bpe is None:
                bpe = encoder_of(path)
            n = pc.fill_null(b.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False)
            a, c = [], []
            for lo, hi in _ranges(n, DIGEST_IDS):
                ids, ends = b.column("ids")[lo:hi].flatten(), np.append(0, np.cumsum(n[lo:hi].astype(np.int64)))
                for out, parts, cut in ((a, bpe.digits, 1), (c, bpe.tokens, 0)):
                    data, offs = _bytes(parts.take(ids))
                    at = offs[ends].tolist()
                    out += [hashlib.sha256(data[x:max(x, y - cut)]).hexdigest() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(a, pa.string()), pa.array(c, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _ranges(sizes, limit: int):
    """Consecutive row ranges with sums of about ``limit``, one row at least."""
    total = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, limit + (total[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def encoder_of(path: str) -> MatrixBPE:
    """The merges of an encoder that this worker already has, or new ones."""
    for (p, _), e in _ENCODERS.items():
        if p == path:
            return e.bpe
    if path not in _MERGES:
        _MERGES[path] = MatrixBPE(load_ranks(path))
    return _MERGES[path]
