"""Periodic runs of words, by recompression.

The words of the texts of a batch become one sequence of numbers, each text closed by a
symbol of its own. ``Grammar`` shortens it level by level: equal neighbours become a block
(symbol, count), then the alphabet is dealt into left and right symbols and every left
symbol followed by a right one becomes a pair; equal blocks and pairs get equal names. The
levels are the rules of a run-length grammar; parsing depends on the symbols alone, so two
places with the same words around them are parsed alike.

``Grammar.extend`` answers longest-common-extension queries exactly, all at once: both
places climb while their symbols agree, stop at the first level where they don't, and walk
down to the first word that differs. Forward and backward use the same levels.

A run with period q and at least 4 q words covers a place x of the grid 0, 3q, 6q, ... with
x + q, x + 2q, x + 3q ... behind it, so the pairs (x, x + q) over all q are the only
candidates: about n log n / 3 of them (the harmonic series). Where the words at both ends agree, the two
extensions give the whole stretch with period q. Of equal stretches the smallest period stays.

Defined results: null and empty texts have no words and no run; a null doc_id repeats
nothing (the repetition that op11 plants needs a number); repeated rows are treated alike,
each on its own; extra columns are ignored. Work is map-only; memory is bounded by a batch
of ``GROUP_BYTES`` or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .word_ids import slices, texts_of, words

GROUP_BYTES = 2_000_000
#: A run needs so many periods and words.
MIN_PERIODS = 4
MIN_WORDS = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal names 0, 1, ...; and the number of names."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate([[False], s[1:] != s[:-1]])
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum()) + 1 if len(keys) else 0


class Grammar:
    """Run-length grammar of a sequence; ``closing`` marks symbols that occur once and are
    never compressed."""

    def __init__(self, symbols: np.ndarray, closing: np.ndarray):
        s, alone = np.asarray(symbols, np.int64), np.asarray(closing, bool)
        self.levels = []  # (symbols, first: starts of the next level's symbols, block level?)
        rnd = 0
        while True:
            same = np.concatenate([[False], s[1:] == s[:-1]])
            if same.any():
                first = np.flatnonzero(~same)
                self.levels.append((s, first, True))
                count = np.diff(np.append(first, len(s)))
                s, alone = self._rename(s[first], count, count > 1, alone[first])
            rnd += 1
            # the side of a symbol is a bit of its hash; of both directions the one with more pairs counts
            side = ((s.astype(np.uint64) + np.uint64(rnd)) * _MIX >> np.uint64(61)) & np.uint64(1) == 1
            open_ = ~alone[:-1] & ~alone[1:]
            ab, ba = side[:-1] & ~side[1:] & open_, ~side[:-1] & side[1:] & open_
            pair = ab if ab.sum() >= ba.sum() else ba
            if not pair.any():
                if not open_.any():
                    break
                continue
            is_first = np.concatenate([[True], ~pair])
            first = np.flatnonzero(is_first)
            self.levels.append((s, first, False))
            two = np.append(pair, False)[first]
            second = np.where(two, s[np.minimum(first + 1, len(s) - 1)], 0)
            s, alone = self._rename(s[first], second, two, alone[first])
        self.top = s

    @staticmethod
    def _rename(s, detail, made, alone):
        """Names for the next level: made symbols by (symbol, detail), the others by symbol."""
        out = np.empty(len(s), np.int64)
        out[made], n = _names((s[made] << np.int64(32)) | detail[made])
        rest = s[~made]
        used = np.zeros(int(rest.max()) + 1 if len(rest) else 0, np.int64)
        used[rest] = 1
        out[~made] = np.cumsum(used)[rest] + (n - 1)
        return out, alone

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Length of the longest common stretch from places ``i < j`` on (or, backwards, up to
        and with them). Both must lie in one text; its closing symbols end every stretch."""
        step = 1 if forward else -1
        a, b = np.array(i, np.int64), np.array(j, np.int64)
        n = len(a)
        stop = np.full(n, len(self.levels), np.int64)
        active = np.arange(n)
        from_ = a.copy()
        for level, (s, first, block) in enumerate(self.levels):
            if not len(active):
                break
            up = self._up(first, len(s))
            edge = np.zeros(len(s) + 1, bool)
            edge[first] = True
            edge[-1] = True
            if not forward:
                edge = edge[1:]
            x, y = a[active], b[active]
            differ = s[x] != s[y]
            inside = ~(edge[x] & edge[y]) & ~differ
            if block:
                rx, ry = self._left(first, up, len(s), x, forward), self._left(first, up, len(s), y, forward)
                m = np.where(inside, np.minimum(rx, ry), 0)
                differ |= inside & (rx != ry)
            else:
                m = inside.astype(np.int64)
            x, y = x + step * m, y + step * m
            a[active], b[active] = x, y
            stop[active[differ]] = level
            keep = ~differ
            active = active[keep]
            a[active], b[active] = up[x[keep]], up[y[keep]]
        # at the top a text is one symbol and its end, so places that got there differ
        for level in range(len(self.levels) - 1, -1, -1):
            s, first, block = self.levels[level]
            q = np.flatnonzero(stop > level)
            if not len(q):
                continue
            if forward:
                x, y = first[a[q]], first[b[q]]
            else:
                last = np.append(first[1:], len(s)) - 1
                x, y = last[a[q]], last[b[q]]
            same = s[x] == s[y]
            if block:
                up = self._up(first, len(s))
                m = np.where(same, np.minimum(self._left(first, up, len(s), x, forward), self._left(first, up, len(s), y, forward)), 0)
            else:
                m = same.astype(np.int64)
            a[q], b[q] = x + step * m, y + step * m
        return (a - from_) * step

    @staticmethod
    def _up(first, n):
        """Symbol of the next level that holds each symbol."""
        up = np.zeros(n, np.int64)
        up[first[1:]] = 1
        return np.cumsum(up)

    @staticmethod
    def _left(first, up, n, x, forward):
        """Symbols of the block of ``x`` from ``x`` on, in the direction."""
        block = up[x]
        return np.append(first, n)[block + 1] - x if forward else x - first[block] + 1


def runs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of the texts whose word numbers stand in ``ids``, ``counts`` words each:
    (text, start in the text, length, period), by text, start, period."""
    n_texts = len(counts)
    # a closing symbol behind each text, and one in front of the first
    place = np.arange(len(ids)) + np.repeat(np.arange(1, n_texts + 1), counts)
    top = int(ids.max()) + 1 if len(ids) else 0
    s = np.empty(len(ids) + n_texts + 1, np.int64)
    closing = np.ones(len(s), bool)
    closing[place] = False
    s[place] = ids
    s[closing] = top + np.arange(n_texts + 1)
    grammar = Grammar(s, closing)
    base = np.concatenate([[1], 1 + np.cumsum(counts + 1)[:-1]]) if n_texts else np.zeros(0, np.int64)

    found = []
    for lo, hi in _slices(counts // MIN_PERIODS):
        text = np.repeat(np.arange(lo, hi), counts[lo:hi] // MIN_PERIODS)
        per = counts[lo:hi] // MIN_PERIODS
        q = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + 1
        n = counts[text]
        grid = np.maximum((MIN_PERIODS - 1) * q, MIN_WORDS - q)
        cells = (n - q - 1) // grid + 1
        cells = np.where(n >= np.maximum(MIN_WORDS, MIN_PERIODS * q), cells, 0)
        for k_lo, k_hi in _slices(cells):
            c = cells[k_lo:k_hi]
            t, p, g = np.repeat(text[k_lo:k_hi], c), np.repeat(q[k_lo:k_hi], c), np.repeat(grid[k_lo:k_hi], c)
            x = base[t] + (np.arange(len(t)) - np.repeat(np.cumsum(c) - c, c)) * g
            hit = np.flatnonzero(s[x] == s[x + p])
            t, p, x = t[hit], p[hit], x[hit]
            # the stretch of places that agree with the place one period later holds three periods,
            # so it holds a neighbour of x: a test of two words spares most extensions
            hit = np.flatnonzero((s[x + 1] == s[x + p + 1]) | (s[x - 1] == s[x + p - 1]))
            t, p, x = t[hit], p[hit], x[hit]
            ahead = grammar.extend(x, x + p, True)
            behind = grammar.extend(x, x + p, False)
            start, length = x - behind + 1, behind + ahead - 1 + p
            ok = length >= np.maximum(MIN_WORDS, MIN_PERIODS * p)
            found.append((t[ok], start[ok] - base[t[ok]], length[ok], p[ok]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    t, start, length, p = (np.concatenate(c) for c in zip(*found))
    # equal stretches: the smallest period is the run's
    order = np.lexsort((p, length, start, t))
    t, start, length, p = t[order], start[order], length[order], p[order]
    new = np.concatenate([[True], (np.diff(t) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)])[:len(t)]
    t, start, length, p = t[new], start[new], length[new], p[new]
    order = np.lexsort((p, start, t))
    return t[order], start[order], length[order], p[order]


def _slices(sizes: np.ndarray, limit: int = 2_000_000):
    """Consecutive index ranges whose sizes sum to about ``limit`` (one index at least)."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo = hi


def planted(counts: np.ndarray, doc_ids: list) -> np.ndarray:
    """Place of the original word that stands at each place, over all texts: in texts whose
    h = crc32(doc_id) divides by 10, words from a = g % n on repeat with period
    1 + (n - a) // (3 + g % 8), g = h // 10."""
    src = np.arange(int(counts.sum()))
    ends = np.cumsum(counts)
    for k, d in enumerate(doc_ids):
        n = int(counts[k])
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = int(ends[k]) - n + a
        src[at:ends[k]] = at + np.arange(n - a) % p
    return src


def dropped(ids_len: int, counts: np.ndarray, text, start, length, period) -> np.ndarray:
    """True for words that a run contains after its first period."""
    offs = np.cumsum(counts) - counts
    edge = np.zeros(ids_len + 1, np.int64)
    np.add.at(edge, offs[text] + start + period, 1)
    np.add.at(edge, offs[text] + start + length, -1)
    return np.cumsum(edge)[:-1] > 0


SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
DIGESTS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs_sha256 string, collapsed_sha256 string")


def _batches(batches, plant: bool):
    """Per group of texts: doc ids, counts, runs (text, start, length, period) and the kept words of each text."""
    for b in batches:
        col, ids_of = b.column("text"), b.column("doc_id").to_pylist()
        texts = texts_of(col)
        for lo, hi in slices(texts, GROUP_BYTES):
            ids, distinct, counts = words(texts.slice(lo, hi - lo))
            if plant:
                ids = ids[planted(counts, ids_of[lo:hi])]
            r = runs(ids, counts)
            names = distinct.to_pylist()
            gone = dropped(len(ids), counts, *r)
            kept_counts = np.add.reduceat(np.append(~gone, False), np.cumsum(counts) - counts, dtype=np.int64) * (counts > 0)
            kept = list(map(names.__getitem__, ids[~gone].tolist()))
            ends = np.cumsum(kept_counts).tolist()
            yield ids_of[lo:hi], r, [" ".join(kept[e - n:e]) for e, n in zip(ends, kept_counts.tolist())]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``runs`` of every text by start and period, and ``collapsed``: the words that no run
    contains after its first period, joined by one space. ``plant`` repeats words of one
    text in ten first (see ``planted``)."""
    ship(docs.sparkSession)

    def run(batches):
        for doc_ids, (t, start, length, period), collapsed in _batches(batches, plant):
            n = np.bincount(t, minlength=len(doc_ids))
            offs = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offs, items), pa.array(collapsed, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per document the number of runs, its longest run, and hashes of runs and collapsed text."""
    ship(docs.sparkSession)

    def run(batches):
        for doc_ids, (t, start, length, period), collapsed in _batches(batches, plant):
            n = np.bincount(t, minlength=len(doc_ids))
            best = [None] * len(doc_ids)
            lines = [[] for _ in doc_ids]
            for k, s, ln, p in zip(t.tolist(), start.tolist(), length.tolist(), period.tolist()):
                lines[k].append(f"{s},{ln},{p}\n")
                # by start, then period: the first of the longest stays
                if best[k] is None or ln > best[k][1]:
                    best[k] = (s, ln, p, 1000 * ln // p)
            longest = list(zip(*[x or (None,) * 4 for x in best])) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(n.astype(np.int64)), *[pa.array(c, pa.int64()) for c in longest],
                 pa.array([hashlib.sha256("".join(x).encode()).hexdigest() for x in lines], pa.string()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in collapsed], pa.string())],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
