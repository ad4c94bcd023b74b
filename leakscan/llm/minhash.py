"""Near-duplicate documents by DartMinHash signatures.

A document is the weighted set of its five-word shingles, the weight being the count; a
text of one to four words is one shingle. Each unit of weight of an element is a region of
its own, ranks are cut into strips of unit length, and each region and strip gets a
Poisson(1) number of darts, all by hashing: documents that share a unit of a shingle share
its darts. A dart has a coordinate and a rank; a signature keeps the earliest rank per
coordinate. Strips are thrown until every coordinate is hit: about k (ln k + 2) darts a document.

Exact copies are one class (128-bit hash of the text). Band hashes join classes into
candidate groups: a star to the smallest member of each bucket, then connected components, so
no pairs are listed. Within a group, similarity (weighted Jaccard on whole shingle sets) is
verified exactly: members whose rarest fifth of shingles meet (two sets with similarity 0.8
must share one of these) form clusters, and in a cluster a pivot is compared with all
members that are not yet linked with it, until every pair is linked through others or was
compared. Groups beyond ``ROUND_UNITS`` shingles are split into blocks by hash; then the
clusters found meet in rounds, each by its smallest member alone, in blocks dealt anew, as long
as a round at least halves the clusters of a group (copies of one text come together in a
round or two, whatever their number). What is left of groups with more than one cluster
is settled by whole sets: blocks of all but the largest cluster meet each other and the blocks of the
largest, of at most ``BLOCK_UNITS`` each. So no link between candidates is lost and no task
holds more than two blocks.

Defined results: null, empty and blank texts link with nothing; component_id is the smallest
doc_id reachable (nulls are ignored while there is another); repeated rows (same doc_id
and text) are copies; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``;
empty tables give empty results. The bands find a pair at similarity 0.8 with probability 0.999.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, sums
from .common import put, ship
from .components import components
from .word_ids import words

WORDS = 5
K, ROWS = 320, 8
BANDS = K // ROWS
ROUND_UNITS, BLOCK_UNITS = 50_000, 1_000_000
RANK_BITS = 36


def mix(x):
    """Finaliser over 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Poisson(1) cumulative probabilities, as 32-bit thresholds.
_CDF = (np.cumsum([1 / np.e / np.prod(np.arange(1, i + 1), dtype=float) for i in range(14)]) * 2**32).astype(np.uint64)


class Shingler:
    """Texts -> sorted unit ids: one id for each shingle and each of its repetitions. Words are split
    and told apart by Arrow's kernels; a distinct word of a slice is hashed once."""

    def units(self, texts):
        """All units, sorted within each text, and their number per text."""
        import pyarrow as pa
        import xxhash
        numbers, distinct, n = words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
        h = np.concatenate([hashes[numbers], np.zeros(WORDS, np.uint64)])
        starts = np.cumsum(n) - n
        shingle = np.zeros(len(numbers), np.uint64)
        for k in range(WORDS):
            shingle = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(numbers)])
        left = np.repeat(starts + n, n) - np.arange(len(numbers))
        keep = left >= WORDS
        for d in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
            x = np.uint64(n[d])
            for w in h[starts[d]:starts[d] + n[d]]:
                x = mix(np.array([x], np.uint64) * np.uint64(3) + w)[0]
            shingle[starts[d]], keep[starts[d]] = x, True
        doc = np.repeat(np.arange(len(texts)), n)[keep]
        shingle = shingle[keep]
        order = np.lexsort((shingle, doc))
        doc, shingle = doc[order], shingle[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        at = np.arange(len(doc))
        nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
        return mix(shingle + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.bincount(doc, minlength=len(texts))


def signatures(units, counts, k: int = K):
    """Earliest rank per coordinate: (documents, k) array; documents without units get zeros."""
    out = np.full((len(counts), k), np.uint64(2**64 - 1))
    out[counts == 0] = 0
    flat = out.reshape(-1)
    todo = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    lo = np.zeros(len(counts), np.int64)
    step = np.where(counts > 0, np.maximum(1, np.ceil(k * (np.log(k) + 2) / np.maximum(counts, 1))), 0).astype(np.int64)
    while len(todo):
        reps = counts[todo] * step[todo]
        for a, b in _runs(reps, 1 << 19):
            part = todo[a:b]
            c, s = counts[part], step[part]
            own = np.concatenate([units[ends[d] - counts[d]:ends[d]] for d in part.tolist()])
            own = np.repeat(own, np.repeat(s, c))
            doc = np.repeat(np.arange(len(part)), c * s)
            strip = np.arange(len(own)) - np.repeat(np.cumsum(c * s) - c * s, c * s)
            strip = (strip % np.repeat(s, c * s) + np.repeat(lo[part], c * s)).astype(np.uint64)
            seed = mix(own ^ mix(strip + np.uint64(1)))
            n = np.searchsorted(_CDF, seed >> np.uint64(32), "right")
            dart = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = mix(np.repeat(seed, n) + (dart.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            coord = ((h >> np.uint64(40)) * np.uint64(k)) >> np.uint64(24)
            rank = (np.repeat(strip, n) << np.uint64(RANK_BITS)) | (h & np.uint64((1 << RANK_BITS) - 1))
            np.minimum.at(flat, np.repeat(part[doc] * k, n) + coord.astype(np.int64), rank)
        lo[todo] += step[todo]
        todo = todo[(out[todo] == np.uint64(2**64 - 1)).any(1)]
    return out


def _runs(sizes, limit):
    """Consecutive (from, to) with sums of about ``limit``, one at least in each."""
    at, total = 0, 0
    for k, s in enumerate(sizes.tolist()):
        if total and total + s > limit:
            yield at, k
            at, total = k, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


def bands(sig, rows: int = ROWS):
    """A 64-bit hash for each band of ``rows`` coordinates."""
    n = sig.shape[1] // rows
    h = np.tile(mix(np.arange(1, n + 1).astype(np.uint64)), (len(sig), 1))
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows][:, :n])
    return h


def _text_class(text):
    """128 bits of a text, in two columns."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(7), text).alias("c2")]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, c1, c2, n_units, bands (array of long, empty without words)."""
    import pyarrow as pa
    ship(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *_text_class("text"))

    def run(batches):
        shingler = Shingler()
        for b in (part for whole in batches for part in slices(whole)):
            units, n = shingler.units(b.column("text"))
            h = bands(signatures(units, n))[n > 0]
            offs = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("c1"), b.column("c2"), pa.array(n.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(h.reshape(-1).view(np.int64)))], names=["doc_id", "c1", "c2", "n_units", "bands"])

    return d.mapInArrow(run, "doc_id bigint, c1 bigint, c2 bigint, n_units bigint, bands array<bigint>")


def candidate_groups(signed: DataFrame) -> DataFrame:
    """(node, component) over c1: classes that share a band, directly or through others."""
    b = signed.select("c1", F.explode("bands").alias("h"))
    buckets = b.groupBy("h").agg(F.min("c1").alias("a"), F.max("c1").alias("top")).where("a < top").select("h", "a")
    return components(b.join(buckets, "h").select("a", F.col("c1").alias("b")))


def similar(inter, a, b):
    """inter / (a + b - inter) >= 0.8, in integers."""
    return 9 * inter >= 4 * (a + b)


def links(sets: list, labels: list):
    """Edges (i, j) that join all members linked by similarity 0.8 or more, for members whose
    labels differ (equal labels: already linked). ``sets``: sorted unit ids."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), size)
    if not len(flat):
        return []
    _, back, freq = np.unique(flat, return_inverse=True, return_counts=True)
    # the rarest fifth and one more of each set, by frequency within this group
    order = np.lexsort((back, freq[back], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    prefix = order[place < np.repeat(size - (4 * size + 4) // 5 + 1, size)]
    prefix = prefix[freq[back[prefix]] > 1]
    order = prefix[np.lexsort((owner[prefix], back[prefix]))]
    same = back[order][1:] == back[order][:-1]
    cluster = _Union(n)
    for i, j in np.unique(np.stack([owner[order][:-1][same], owner[order][1:][same]], 1), axis=0).tolist():
        cluster.join(i, j)
    members: dict = {}
    for i in range(n):
        members.setdefault(cluster.find(i), []).append(i)
    out: list = []
    for ms in members.values():
        if len(ms) > 1:
            _pivots(ms, sets, size, labels, out)
    return out


def _pivots(ms, sets, size, labels, out):
    known = _Union(len(ms))
    by_label: dict = {}
    for k, i in enumerate(ms):
        if labels[i] in by_label:
            known.join(k, by_label[labels[i]])
        by_label.setdefault(labels[i], k)
    own = size[ms]
    flat, ends = np.concatenate([sets[i] for i in ms]), np.cumsum(own)
    used = np.zeros(len(ms), bool)
    while True:
        root = np.array([known.find(k) for k in range(len(ms))])
        count = np.bincount(root, minlength=len(ms))
        if count.max() == len(ms):
            return
        # a pair is settled when one of the two was a pivot: the largest component needs none
        open_ = ~used & (root != count.argmax())
        if not open_.any():
            return
        k = int(np.flatnonzero(open_)[np.argmax(count[root[open_]])])
        used[k] = True
        other = np.flatnonzero((root != root[k]) & (5 * own >= 4 * own[k]) & (5 * own[k] >= 4 * own))
        if not len(other):
            continue
        part = np.concatenate([flat[ends[j] - own[j]:ends[j]] for j in other.tolist()])
        pivot = sets[ms[k]]
        hit = pivot[np.minimum(np.searchsorted(pivot, part), len(pivot) - 1)] == part
        for j in other[similar(sums(hit, own[other]), own[other], own[k])].tolist():
            known.join(k, j)
            out.append((ms[k], ms[j]))


class _Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _verify(members: DataFrame) -> DataFrame:
    """``members`` (job string, node, label, text) -> edges (a, b) within each job."""
    import pyarrow as pa
    ship(members.sparkSession)

    def run(batches):
        from itertools import groupby
        shingler = Shingler()
        rows = (r for b in batches for r in b.to_pylist())
        a, z = [], []
        for _, own in groupby(rows, key=lambda r: r["job"]):
            nodes, labels, sets, texts = [], [], [], []

            def flush():
                units, n = shingler.units(texts)
                ends = np.cumsum(n)
                sets.extend(np.sort(units[e - k:e]) for e, k in zip(ends.tolist(), n.tolist()))
                texts.clear()

            for r in own:
                if nodes and nodes[-1] == r["node"]:
                    continue
                nodes.append(r["node"])
                labels.append(r["label"])
                texts.append(r["text"])
                if len(texts) >= 200:
                    flush()
            flush()
            for i, j in links(sets, labels):
                a.append(nodes[i])
                z.append(nodes[j])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(z, pa.string())], names=["a", "b"])
                a, z = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(z, pa.string())], names=["a", "b"])

    return members.select("job", "node", "label", "text").repartition("job").sortWithinPartitions("job", "node").mapInArrow(run, "a string, b string")


def _dealt(rows: DataFrame, units: int, salt: int = 0) -> DataFrame:
    """Adds nb (blocks of a group, of about ``units`` shingles each) and block."""
    sizes = rows.groupBy("grp").agg(F.ceil(F.sum("n_units") / units).alias("nb"))
    return rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "node"), "nb"))


def _open(state: DataFrame) -> DataFrame:
    """Groups of more than one cluster, with their number."""
    return state.where("node = label").groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")


def _settle(members: DataFrame, texts: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """More edges for groups of several blocks. ``members`` (grp, node, n_units), ``texts`` (grp, node, text),
    ``found`` and ``labels``: edges within blocks, and their components. A label is the smallest node of
    its cluster."""
    state = put(members.join(labels, "node", "left").select("grp", "node", "n_units", F.coalesce("component", "node").alias("label")), "state")
    open_, turn = put(_open(state), "open"), 0
    while not open_.isEmpty():
        turn += 1
        heads = _dealt(state.where("node = label").join(open_.select("grp"), "grp"), min(ROUND_UNITS, BLOCK_UNITS), turn)
        more = put(_verify(heads.join(texts, ["grp", "node"]).withColumn("job", F.concat_ws(":", "grp", "block"))), "links")
        found = found.unionByName(more)
        merged = components(more).select(F.col("node").alias("label"), "component")
        state = put(state.join(merged, "label", "left").select("grp", "node", "n_units", F.coalesce("component", "label").alias("label")), "state")
        open_ = put(_open(state).join(open_.select("grp", F.col("n").alias("before")), "grp").where("2 * n <= before").select("grp", "n"), "open")
    # the largest cluster of a group is compared with the rest alone, both in blocks of the rest's size
    by_label = state.join(_open(state).select("grp"), "grp").groupBy("grp", "label").agg(F.sum("n_units").alias("u"))
    total = by_label.groupBy("grp").agg(F.sum("u").alias("all"), F.max(F.struct("u", "label")).alias("top"))
    unit = F.least(F.lit(BLOCK_UNITS), F.greatest(F.lit(min(ROUND_UNITS, BLOCK_UNITS)), F.col("all") - F.col("top.u")))
    total = total.select("grp", F.col("top.label").alias("main"), F.ceil(F.col("top.u") / unit).alias("n_main"), F.ceil((F.col("all") - F.col("top.u")) / unit).alias("n_rest"))
    rest = state.join(total, "grp").withColumn("in_main", F.col("label") == F.col("main"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_rest"))))
    with_main = "transform(sequence(0L, n_main - 1), j -> concat('r', block, 'm', j))"
    with_rest = "transform(filter(sequence(0L, n_rest - 1), i -> i <> block), i -> concat('r', least(i, block), 'r', greatest(i, block)))"
    pairs = F.expr(f"CASE WHEN in_main THEN transform(sequence(0L, n_rest - 1), i -> concat('r', i, 'm', block)) ELSE concat({with_main}, {with_rest}) END")
    rest = rest.select("grp", "node", "label", F.explode(pairs).alias("pair")).join(texts, ["grp", "node"]).withColumn("job", F.concat_ws(":", "grp", "pair"))
    return put(found.unionByName(_verify(rest)), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, c1, c2, class_id (smallest doc_id with the same text), component_id, kept, n_rows
    (rows with this doc_id and text); one row per input row."""
    signed = put(sign(docs), "signed")
    classes = signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n_units").alias("n_units"))
    groups_ = candidate_groups(signed).select(F.col("node").alias("c1"), F.col("component").alias("grp"))
    node = F.concat_ws("-", F.col("c1").cast("string"), F.col("c2").cast("string")).alias("node")
    members = put(classes.join(groups_, "c1").select("grp", "rep", "c1", "c2", node, "n_units"), "members")
    members = _dealt(members, min(ROUND_UNITS, BLOCK_UNITS))
    # the texts of candidates alone; c1 and c2 settle rows that share a doc_id
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hit = [text.doc_id.eqNullSafe(members.rep), F.xxhash64("text") == members.c1, F.xxhash64(F.lit(7), "text") == members.c2]
    with_text = text.join(members, hit[0] & hit[1] & hit[2]).select("grp", "block", "nb", "node", "text")
    big = not members.where("nb > 1").limit(1).isEmpty()
    if big:
        with_text = put(with_text, "texts")
    found = put(_verify(with_text.withColumn("job", F.concat_ws(":", "grp", "block")).withColumn("label", F.col("node"))), "links")
    labels = components(found)
    if big:
        found = _settle(members.where("nb > 1").select("grp", "node", "n_units"), with_text.where("nb > 1").select("grp", "node", "text"), found, labels)
        labels = components(found)
    own = classes.select("c1", "c2", F.col("rep").alias("class_id"), node)
    own = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = own.join(own.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min(F.struct(F.col("class_id").isNull(), "class_id", "node")).alias("first")), "component")
    own = own.select("c1", "c2", "class_id", "component_id", (F.col("first.node") == F.col("node")).alias("leads"))
    n_rows = signed.groupBy("doc_id", "c1", "c2").agg(F.count("*").alias("n_rows"), F.max("n_units").alias("n_units"))
    out = n_rows.join(own, ["c1", "c2"])
    blank = F.col("n_units") == 0
    out = out.select("doc_id", "c1", "c2", "n_rows",
                     F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                     F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                     (blank | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"), blank.alias("blank"))
    return out


def per_row(found: DataFrame) -> DataFrame:
    """One row per input row again: of repeated rows, one is kept."""
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))).withColumn(
        "kept", F.col("kept") & (F.col("blank") | (F.col("copy") == 1))).select("doc_id", "class_id", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, all without words."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("k_id"), "c1", "c2", "n_rows", "blank")
    d = docs.withColumns({"h1__": F.xxhash64(F.coalesce("text", F.lit(""))), "h2__": F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))})
    d = d.join(kept, d.doc_id.eqNullSafe(kept.k_id) & (d.h1__ == kept.c1) & (d.h2__ == kept.c2))
    single = (F.col("n_rows") == 1) | F.col("blank")
    cols = docs.columns
    return d.where(single).select(*cols).unionByName(d.where(~single).dropDuplicates(["doc_id", "h1__", "h2__"]).select(*cols))
