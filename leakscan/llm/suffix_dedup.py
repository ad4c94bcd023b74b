"""Repeated passages by column-wise construction of multi-document suffix collections.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
document of smaller id, or earlier in the same one; of different texts with one id, or without any,
in the one of smaller hash). Windows of that length are grouped by their
anchor: the smallest hash among the window's 50-byte strings. Equal windows have equal anchors, so
runs of windows with the same anchor (100 to 150 bytes of text) are the unit that travels:

1. Of documents with the same text the first counts; in the others every window starts
   earlier.
2. Anchors that occur in one text only, and there once, cannot hold a repeated window and are
   dropped.
3. Runs with equal bytes are one string, kept with its first place (map-side combine).
4. Strings of the same anchor meet in one collection. There the suffixes of all strings are
   built column by column: each round puts one more symbol in front of every string and
   inserts the new suffixes into the Burrows-Wheeler transform and the common-prefix
   array, both rewritten front to back in sequential passes. Rows that share a prefix of 100
   bytes are equal windows; the first place of each is kept. A string that is alone at its anchor
   needs no rounds: its windows all differ.
5. Per document, the windows of repeated anchors that are not a first place are removed.

A collection is about ``COLLECTION`` bytes. Strings of an anchor with more than ``HOT``
different strings are cut into their windows, which meet by their own bytes instead (the
column-wise construction of one window alone is its grouping), so no task gathers them.

Defined results: null texts are empty; null doc_ids come last; rows that share a doc_id and the
text count as one document, so repeated rows give equal results; different texts that share a
doc_id, or have none, are documents of their own; texts under 100 bytes lose nothing; extra columns are kept by ``remove`` and ignored otherwise; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, ship

LENGTH = 100
ANCHOR = 50
COLLECTION = 1 << 19
HOT = 50_000
ROWS = 500               # whose texts are cut at a time
FLAT = 1 << 20
PLACE_BITS = 21          # of a place within a part; fixed, so that hashes compare alike in every text
LAST = 2**63 - 1
#: Multipliers of a string's 8-byte words.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def anchors(data: np.ndarray):
    """For the windows of one text or a part of it: (window starts of each run, window count of
    each run, 48-bit anchor of each run)."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    # 8-byte words by unaligned loads, folded into hashes of ANCHOR bytes
    m = len(data) - ANCHOR + 1
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    h, part = np.zeros(m, np.uint64), np.empty(m, np.uint64)
    for at, odd in zip((0, 8, 16, 24, 32, 40, ANCHOR - 8), _ODD):
        h += np.multiply(words[at:at + m], odd, out=part)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    # smallest of each 51 by minima of 2, 4, ... 32 neighbours; the place breaks ties leftmost
    w = LENGTH - ANCHOR + 1
    bits = np.uint64(PLACE_BITS)
    key = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
    wide = 1
    while 2 * wide <= w:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    at = (np.minimum(key[:n], key[w - wide:w - wide + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n)), (h[at[starts]] >> np.uint64(16)).astype(np.int64)


def runs(text: bytes):
    """``anchors`` of a whole text, in parts of ``FLAT`` windows. Parts cut runs, never windows;
    places within a part are ranked alike at any length."""
    data = np.frombuffer(text, np.uint8)
    out = [], [], []
    for lo in range(0, max(1, len(data) - LENGTH + 1), FLAT):
        s, n, g = anchors(data[lo:lo + FLAT + LENGTH - 1])
        for o, x in zip(out, (s + lo, n, g)):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def collect(strings: list[bytes]):
    """Column-wise construction over ``strings``. Returns (string, start, group) of every suffix
    of ``LENGTH`` bytes or more; suffixes of one group share their first ``LENGTH`` bytes."""
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(size)
    # the bytes that occur, from 1 on, in byte order; 0 stands in front of a string's start
    codes = np.zeros(256, np.uint16)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    codes[present] = np.arange(1, len(present) + 1)
    flat = codes[flat].astype(np.uint8 if len(present) < 256 else np.uint16)
    # rows in suffix order: the transform's symbol and the common prefix with the row before;
    # row i is the empty suffix of string i. ``fresh``: rows whose symbol makes a new suffix,
    # ``who``: their strings
    bwt = flat[ends - 1]
    lcp = np.zeros(m, np.uint8)
    fresh, who = np.arange(m), np.arange(m)
    for j in range(1, int(size.max(initial=0)) + 1):
        order = np.argsort(bwt, kind="stable")
        order = order[np.count_nonzero(bwt == 0):]
        marked = np.zeros(len(bwt), bool)
        marked[fresh] = True
        at = np.flatnonzero(marked[order])         # new suffixes among those with a first symbol
        who = who[np.searchsorted(fresh, order[at])]
        touched = np.zeros(len(order) + 1, bool)
        touched[at] = touched[at + 1] = True
        touched[0] = touched[-1] = False
        t = np.flatnonzero(touched)
        a, b = order[t - 1], order[t]
        same = bwt[a] == bwt[b]
        low = np.zeros(len(t), np.uint16)
        if same.any():
            # from the last pair to the first, so that what lies between two pairs is not read
            first, last = a[same] + 1, b[same] + 1
            down = np.argsort(-first)
            least = np.empty(len(down), np.uint16)
            least[down] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), np.stack([first[down], last[down]], 1).reshape(-1))[::2]
            low[same] = least + np.uint16(1)
        old = np.ones(m + len(order), bool)
        old[m + at] = False
        prefix, symbols = np.zeros(len(old), np.uint8), np.zeros(len(old), bwt.dtype)
        prefix[old], symbols[old] = lcp, bwt
        prefix[m:m + 1] = 0
        prefix[m + t] = np.minimum(low, LENGTH)
        more = size[who] > j
        symbols[m + at[more]] = flat[ends[who[more]] - j - 1]
        bwt, lcp, fresh, who = symbols, prefix, m + at[more], who[more]
    # places of all suffixes, by walking the finished transform from the empty ones
    front = np.zeros(len(bwt), np.int64)
    order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0):]
    front[order] = m + np.arange(len(order))
    group = np.cumsum(lcp < LENGTH)
    row, own = np.arange(m), np.arange(m)
    out: list = [], [], []
    for j in range(1, int(size.max(initial=0)) + 1):
        go = size[own] >= j
        own, row = own[go], front[row[go]]
        if j >= LENGTH:
            for o, x in zip(out, (own, size[own] - j, group[row])):
                o.append(x)
    return tuple(np.concatenate([np.zeros(0, np.int64), *o]) for o in out)


def first_places(strings: list[bytes], docs, starts):
    """(doc, from, to): windows of the strings that start nowhere earlier in the collection."""
    s, off, group = collect(strings)
    doc, place = docs[s], starts[s] + off
    order = np.lexsort((place, doc, group))
    lead = np.ones(len(order), bool)
    lead[1:] = group[order][1:] != group[order][:-1]
    doc, place = doc[order][lead], place[order][lead]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(doc)) - 1 if len(begin) else begin
    return doc[begin], place[begin], place[last]


def _scan(docs: DataFrame) -> DataFrame:
    """(g, c1, c2, key, n): the different anchors of every document, with its text's hashes and their number."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                *own, texts = (b.column(c)[lo:lo + 64] for c in ("c1", "c2", "key", "bytes"))
                found = [np.unique(runs(t)[2], return_counts=True) for t in texts.to_pylist()]
                size = [len(g) for g, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g for g, _ in found])), *[pa.array(np.repeat(x.to_numpy(zero_copy_only=False), size)) for x in own],
                     pa.array(np.concatenate([n for _, n in found]))],
                    names=["g", "c1", "c2", "key", "n"])

    return docs.select("c1", "c2", "key", "bytes").mapInArrow(run, "g bigint, c1 bigint, c2 bigint, key bigint, n bigint")


def _repeated(seen: DataFrame) -> DataFrame:
    """(g, key, c1, c2): anchors that come twice in a text or in different texts, for the first document of
    each text. The rows of an anchor stream by, sorted; a task holds one batch."""
    import pyarrow as pa

    def run(batches):
        held = [np.zeros(0, np.int64)] * 5
        names = ["g", "key", "c1", "c2"]

        def lead(cols, done):
            """First row of each (g, c1, c2) whose g has several of them or a count over one; the
            rows of the last g stay, one per text, unless all are done."""
            g, key, c, c2, n = cols
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
            start = np.flatnonzero(first)
            top = np.maximum.reduceat(n, start) if len(start) else n
            g, key, c, c2, n = g[first], key[first], c[first], c2[first], top
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            group = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            many = (np.diff(np.append(begin, len(g))) > 1) | (np.maximum.reduceat(n, begin) > 1) if len(g) else new
            ok = many[group] if len(g) else new
            last = len(g) if done or not len(g) else int(begin[-1])
            if last < len(g) and ok[last]:
                # known to be repeated: all but the newest row can go, which keeps the mark
                out = ok.copy()
                out[-1] = False
                return [x[out] for x in (g, key, c, c2)], [x[-1:] for x in (g, key, c, c2, np.maximum(n, 2))]
            ok[last:] = False
            return [x[ok] for x in (g, key, c, c2)], [x[last:] for x in (g, key, c, c2, n)]

        for b in batches:
            cols = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for h, k in zip(held, (*names, "n"))]
            rows, held = lead(cols, False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)
        rows, _ = lead(held, True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)

    return seen.repartition("g").sortWithinPartitions("g", "c1", "c2", "key").mapInArrow(run, "g bigint, key bigint, c1 bigint, c2 bigint")


def _lists(col):
    """(ends, values) of a list column from 0 on; null lists are empty."""
    import pyarrow.compute as pc
    return [0, *np.cumsum(pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()], col.flatten()


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of the values are in ``few``."""
    if not len(few):
        return np.zeros(len(values), bool)
    few = np.sort(few)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def string_batches(batches):
    """The strings of many texts in a batch, about ``FLAT`` bytes of text in each."""
    import pyarrow as pa

    def batch(key, size, g, s, start):
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.binary()), pa.array(np.repeat(key.to_numpy(zero_copy_only=False), size), pa.int64()),
                                           pa.array(start, pa.int64())], names=["g", "s", "key", "start"])

    for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
        found: list = [], [], []
        size = []
        ends, values = _lists(b.column("gs"))
        gs, held = values.to_numpy(zero_copy_only=False), 0
        for text, lo, hi in zip(b.column("bytes").to_pylist(), ends[:-1], ends[1:]):
            s, n, g = runs(text)
            ok = _among(g, gs[lo:hi])
            seen: dict = {}
            for at, k, a in zip(s[ok].tolist(), n[ok].tolist(), g[ok].tolist()):
                seen.setdefault((a, text[at:at + k + LENGTH - 1]), at)
            size.append(len(seen))
            for o, x in zip(found, ([k[0] for k in seen], [k[1] for k in seen], seen.values())):
                o += x
            held += len(text)
            if held >= FLAT:
                yield batch(b.column("key")[:len(size)], size, *found)
                b, held = b.slice(len(size)), 0
                for o in (*found, size):
                    o.clear()
        yield batch(b.column("key"), size, *found)


def _strings(hits: DataFrame) -> DataFrame:
    """(g, s, key, start): the runs of repeated anchors, once per text and string; ``key`` is the
    number of the text from here on."""
    return hits.select("key", "bytes", "gs").mapInArrow(string_batches, "g bigint, s binary, key bigint, start bigint")


def _firsts(strings: DataFrame) -> DataFrame:
    """(key, lo, hi): windows that start nowhere earlier."""
    import pyarrow as pa

    def run(batches):
        held: list = [], [], [], []
        size, last = 0, None

        def flush():
            strings, (key, start, g) = list(held[0]), (np.array(h, np.int64) for h in held[1:])
            for h in held:
                h.clear()
            # a string alone at its anchor: equal windows would have their smallest hash at
            # different places, so all of its windows differ and stay
            new = np.ones(len(g) + 1, bool)
            new[1:-1] = g[1:] != g[:-1]
            alone = new[:-1] & new[1:]
            n = np.fromiter(map(len, strings), np.int64, len(strings))[alone] - LENGTH
            out = [(key[alone], start[alone], start[alone] + n)]
            if not alone.all():
                out.append(first_places([strings[i] for i in np.flatnonzero(~alone).tolist()], key[~alone], start[~alone]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["key", "lo", "hi"])

        for b in batches:
            for g, s, key, start in zip(*(b.column(c).to_pylist() for c in ("g", "s", "key", "start"))):
                if size >= COLLECTION and g != last:
                    yield flush()
                    size = 0
                last, size = g, size + len(s)
                for h, x in zip(held, (s, key, start, g)):
                    h.append(x)
        if held[0]:
            yield flush()

    return strings.repartition("g").sortWithinPartitions("g").mapInArrow(run, "key bigint, lo bigint, hi bigint")


def _first_of(strings: DataFrame, *by: str) -> DataFrame:
    """The first place (key, then start) of each string."""
    place = F.col("key").cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("start")
    d = strings.select(*by, place.cast("decimal(38,0)").alias("place")).groupBy(*by).agg(F.min("place").alias("place"))
    key = F.floor(F.col("place") / F.lit(1 << 40).cast("decimal(13,0)")).cast("bigint")
    return d.withColumn("key", key).withColumn("start", (F.col("place") - key.cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(13,0)")).cast("bigint")).drop("place")


def _windows(strings: DataFrame) -> DataFrame:
    """(s, key, start): the windows of hot strings, one row each."""
    return strings.select(F.explode(F.expr(f"transform(sequence(0, octet_length(s) - {LENGTH}), i -> struct(substring(s, i + 1, {LENGTH}) AS s, key AS key, start + i AS start))")).alias("w")).select("w.*")


def _with_places(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, the columns named in ``carry``, ``bytes``, and what ``removed`` needs to know of each text:
    ``f_key``, ``gs``, ``firsts``. The texts are scanned where they lie and cross the cluster twice by
    doc_id and hash: to meet their repeated anchors, and their first places."""
    ship(docs.sparkSession)
    d = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", *[f"`{c}`" for c in carry])
    d = d.withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(7), "text"), "bytes": F.col("text").cast("binary")}).drop("text")
    # different texts, numbered by the id they come with first; a number is one text's alone, ids need not be
    firsts = d.groupBy("c1", "c2").agg(F.min("key").alias("f_key")).orderBy("f_key", "c1", "c2").withColumn("no", F.monotonically_increasing_id())
    firsts = put(firsts.toDF("f1", "f2", "f_key", "no"), "firsts")
    per_doc = put(_repeated(_scan(d)).groupBy(F.col("key").alias("g_key"), F.col("c1").alias("g1"), F.col("c2").alias("g2")).agg(F.collect_set("g").alias("gs")), "anchors")
    text = (F.col("f_key") == F.col("g_key")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    row = (F.col("key") == F.col("f_key")) & (F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2"))
    hits = d.select("key", "bytes", "c1", "c2").join(firsts.join(per_doc, text), row).select(F.col("no").alias("key"), "bytes", "gs")
    strings = put(_first_of(_strings(hits), "g", "s"), "strings")
    hot = strings.groupBy("g").agg(F.count("*").alias("n_strings")).where(F.col("n_strings") > HOT)
    cool = strings.join(hot, "g", "left")
    window = _first_of(_windows(cool.where("n_strings IS NOT NULL")), "s").select("key", F.col("start").alias("lo"), F.col("start").alias("hi"))
    places = _firsts(strings.join(hot, "g", "left_anti")).unionByName(window)
    places = put(places.groupBy(F.col("key").alias("p_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("firsts")), "places")
    full = d.join(firsts.join(per_doc, text, "left").join(places, F.col("no") == F.col("p_key"), "left"), row, "left")
    names = ["doc_id", *carry, "bytes", "f_key", "gs", "firsts"]
    return full.select(*[f"`{c}`" for c in names])


def _cuts(batch):
    """(bytes, removed runs) of each row of a batch of ``_with_places``."""
    g_ends, gs = _lists(batch.column("gs"))
    f_ends, firsts = _lists(batch.column("firsts"))
    gs, lo, hi = (x.to_numpy(zero_copy_only=False) for x in (gs, *firsts.flatten()))
    copy = batch.column("f_key").is_null().to_pylist()
    for k, text in enumerate(batch.column("bytes").to_pylist()):
        f = slice(f_ends[k], f_ends[k + 1])
        yield text, removed(text, copy[k], gs[g_ends[k]:g_ends[k + 1]], lo[f], hi[f])


def spans(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``bytes`` and ``spans`` (array of struct<start, stop>: the maximal removed runs of
    bytes)."""
    import pyarrow as pa
    carry = carry or []
    full = _with_places(docs, carry)
    schema = full.select("doc_id", *[f"`{c}`" for c in carry], "bytes").withColumn("spans", F.lit(None).cast("array<struct<start: bigint, stop: bigint>>")).schema

    def run(batches):
        for b in batches:
            out = [cuts for _, cuts in _cuts(b)]
            ends = np.append(0, np.cumsum([len(c) for c in out])).astype(np.int32)
            flat = np.array([x for c in out for x in c], np.int64).reshape(-1, 2)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "stop"]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *carry, "bytes")], found], names=["doc_id", *carry, "bytes", "spans"])

    return full.mapInArrow(run, schema)


def removed(text: bytes, copy: bool, gs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes: ``copy`` for a later copy of a whole text, ``gs`` the
    repeated anchors, ``lo`` to ``hi`` the windows that stay."""
    n = len(text) - LENGTH + 1
    if n <= 0 or not (copy or len(gs)):
        return []
    if copy:
        return [(0, len(text))]
    s, k, g = runs(text)
    ok = _among(g, gs)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s[ok], 1)
    np.add.at(edge, s[ok] + k[ok], -1)
    np.add.at(edge, lo, -1)
    np.add.at(edge, hi + 1, 1)
    covers = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(covers):
        return []
    cut = np.flatnonzero(np.diff(covers) > LENGTH) + 1
    lo, hi = covers[np.append(0, cut)], covers[np.append(cut - 1, len(covers) - 1)] + LENGTH
    return list(zip(lo.tolist(), hi.tolist()))


def digests(spanned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            ends, cut = _lists(b.column("spans"))
            cut = list(zip(*(x.to_pylist() for x in cut.flatten())))
            for text, lo, hi in zip(b.column("bytes").to_pylist(), ends[:-1], ends[1:]):
                cuts = cut[lo:hi]
                gone = sum(z - a for a, z in cuts)
                rows.append((len(text), gone, len(cuts), hashlib.sha256(rest(text, cuts)).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spanned.select("doc_id", "bytes", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def rest(text: bytes, cuts: list) -> bytes:
    """The text without the runs (from, to)."""
    out, at = [], 0
    for a, z in cuts:
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


def remove(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without their removed bytes. A character that is removed in part stays;
    a text that loses nothing stays as it is, null texts too; ``n_chars``, if there, is counted again.
    Runs are found and cut in one step, so that a task has one Python worker."""
    import pyarrow as pa
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    full = _with_places(docs.withColumn("null__", F.col("text").isNull()), [*others, "null__"])
    schema = full.select("doc_id", *[f"`{c}`" for c in others]).withColumn("text", F.lit(None).cast("string")).schema

    def run(batches):
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts = []
            for (text, cuts), null in zip(_cuts(b), b.column("null__").to_pylist()):
                whole = []
                for a, z in cuts:
                    while a < z and text[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
                        z -= 1
                    whole.append((a, z))
                texts.append(None if null else rest(text, whole).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in others], pa.array(texts, pa.string())], names=["doc_id", *others, "text"])

    out = full.mapInArrow(run, schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
