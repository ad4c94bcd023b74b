"""Similar embeddings by spherical-cap filters.

Filter directions form structured random product codes: after a random rotation the dimensions
are cut into three blocks, each with some random unit vectors, and every triple of code
vectors is one direction (``ROTATIONS`` codes even out the lists). A
vector is list-decoded to all directions on which its projection exceeds the cap, and the
nearest one of each rotation: pairs of code vectors that can't reach the cap with the best
third are pruned. Vectors close to each other share some of their directions; they join
on them and the cosine is verified in double precision.

Cap and code size follow from the number of different vectors: a direction is exceeded by about
``MEMBERS`` unrelated vectors and a vector exceeds about ``LISTED`` directions at any size, so
that the work of a vector doesn't grow with the table (but for list decoding, by its power 2/3).

Equal vectors are one class. A pair that meets on several directions counts on the smallest one
only, found by the incidence of members and smaller directions. Members of a direction beyond
``BLOCK`` are split into blocks by hash and all pairs of blocks are jobs of their own, so a
crowded direction is neither cut nor gathered in one task. A job gives sums of links and a
spanning forest, never pairs.

Vectors of each length are a space of their own, with its own directions and cap. Components keep their precision (float or double).

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are their own component; vectors of different
lengths don't link; repeated rows are vectors of their own in one class; extra columns are ignored; an empty table gives an empty result.
Every vector is decoded; tests measure the share of links found against brute force.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, ship
from .components import components

ROTATIONS = 10
MEMBERS = 8         # unrelated vectors on a direction, besides nearest ones
LISTED = 16         # directions that a vector exceeds
LEAST_CODES = 4
MAX_CAP = 0.9       # as a projection, in few dimensions
BLOCK = 2048
COSINE = 0.95
SEED = 4


def code(dim: int = 64, codes: int = 32):
    """(slice, code vectors) of the three blocks; the same on every machine."""
    rnd = np.random.Generator(np.random.PCG64(SEED))
    edges = np.linspace(0, dim, 4).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        # few dimensions need few code vectors: none but the zero vector, both signs, then 4 a dimension
        c = rnd.standard_normal((min(codes, 1 if a == b else 2 if b - a == 1 else 4 ** min(4, int(b - a))), b - a))
        if b - a == 1:
            c = np.array([[1.0], [-1.0]])
        out.append((slice(a, b), c / np.linalg.norm(c, axis=1, keepdims=True) if a < b else c))
    return out


def size_of(total: int) -> int:
    """Code vectors of a block, for ``total`` different vectors."""
    return max(LEAST_CODES, int(np.ceil((LISTED * total / MEMBERS / ROTATIONS) ** (1 / 3))))


def cap_of(dim: int, total: int) -> float:
    """The projection that a vector must exceed."""
    return min(MAX_CAP, NormalDist().inv_cdf(1 - min(0.1, MEMBERS / total)) / np.sqrt(dim))


def rotations(dim: int):
    """Random orthogonal matrices; the same on every machine."""
    rnd = np.random.Generator(np.random.PCG64(SEED + 1))
    return [np.linalg.qr(rnd.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)]


def directions(x, blocks, turns, cap: float):
    """Sorted numbers of the directions of each row, over all rotations."""
    each = int(np.prod([len(c) for _, c in blocks]))
    lists = [decode(x @ r, blocks, cap) for r in turns]
    return [np.concatenate([v + k * each for k, v in enumerate(own)]) for own in zip(*lists)]


def decode(x, blocks, cap: float):
    """Directions (sorted numbers) that each row of ``x`` exceeds; the nearest one in any case."""
    p, q, r = (x[:, s] @ c.T for s, c in blocks)
    k0, k1, k2 = (len(c) for _, c in blocks)
    need = cap * np.sqrt(3.0)
    best = (p.argmax(1) * k1 + q.argmax(1)) * k2 + r.argmax(1)
    step = max(1, 1_000_000 // (k0 * k1))
    out = []
    for lo in range(0, len(x), step):
        pairs = p[lo:lo + step, :, None] + q[lo:lo + step, None, :]
        top = r[lo:lo + step].max(1)
        row, i, j = np.nonzero(pairs >= (need - top)[:, None, None])
        third = [np.nonzero(r[lo + row[k:k + 20_000]] >= need - pairs[row[k:k + 20_000], i[k:k + 20_000], j[k:k + 20_000]][:, None])
                 for k in range(0, len(row), 20_000)]
        at = np.concatenate([t[0] + 20_000 * k for k, t in enumerate(third)]) if third else np.zeros(0, np.int64)
        f = (i[at] * k1 + j[at]) * k2 + (np.concatenate([t[1] for t in third]) if third else at)
        # rows, pairs and thirds come in order, so the numbers of a row do
        lists = np.split(f, np.searchsorted(row[at], np.arange(1, len(pairs))))
        out += [v if len(v) else best[lo + k:lo + k + 1] for k, v in enumerate(lists)]
    return out


def _unit(raw):
    """Rows of double precision, scaled to length 1."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)         # no overflow or underflow in the norms
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(classes: DataFrame, kind: str) -> DataFrame:
    """(node, n, dim, x, filters) of every class that can link."""
    import pyarrow as pa
    ship(classes.sparkSession)

    def run(batches):
        spaces: dict = {}
        for b in batches:
            lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = b.take(pa.array(np.flatnonzero(lengths == dim)))
                if dim not in spaces:
                    total = own.column("total")[0].as_py()
                    spaces[dim] = code(dim, size_of(total)), rotations(dim), cap_of(dim, total)
                for lo in range(0, own.num_rows, 500):
                    part = own.slice(lo, 500)
                    raw = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    lists = directions(_unit(raw), *spaces[dim])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("n"), pa.array([dim] * len(raw), pa.int32()), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                        names=["node", "n", "dim", "x", "filters"])

    sized = classes.select("node", "n", "embedding", F.size("embedding").alias("dim"))
    # one number a length; the side is joined without a hint
    sized = sized.join(sized.groupBy("dim").agg(F.count("*").alias("total")), "dim")
    return sized.select("node", "n", "embedding", "total").mapInArrow(run, "node string, n bigint, dim int, x binary, filters array<bigint>")


def linked(x, n, filters, f, block=None):
    """Sums of links and a root for each member of one job: pairs with the cosine or more that
    share no direction below ``f``; of different ``block`` if given. None if there is no such pair."""
    m = len(x)
    hit = np.zeros((m, m), bool)
    for lo in range(0, m, 512):
        hit[lo:lo + 512] = x[lo:lo + 512] @ x.T >= COSINE
    hit[np.arange(m), np.arange(m)] = False
    hit &= hit.T
    if block is not None:
        hit &= block[:, None] != block[None, :]
    some = np.flatnonzero(hit.any(1))
    if not len(some):
        return None
    small = [filters[k][filters[k] < f] for k in some]
    seen, at, count = np.unique(np.concatenate(small), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(some)), list(map(len, small)))
    ok = count[at] > 1
    if ok.any():
        number = np.cumsum(count > 1) - 1
        inc = np.zeros((len(some), number[-1] + 1), np.float32)
        inc[who[ok], number[at[ok]]] = 1
        for lo in range(0, len(some), 512):
            met = inc[lo:lo + 512] @ inc.T > 0
            hit[np.ix_(some[lo:lo + 512], some)] &= ~met
    root = np.arange(m)
    while True:
        low = np.minimum(root, np.where(hit, root[None, :], m).min(1)) if m else root
        low = low[low]
        if (low == root).all():
            break
        root = low
    return (hit * n[None, :]).sum(1), root


def _runs(batches, keys):
    """Tables of whole jobs with the bounds of each; rows come sorted by ``keys``. A job has at
    most two blocks of members, so what is carried to the next batch is bounded."""
    import pyarrow as pa
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        key = np.stack([t.column(k).to_numpy() for k in keys])
        bounds = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if len(bounds):
            yield t.slice(0, bounds[-1]).combine_chunks(), np.concatenate([[0], bounds])
            t = t.slice(bounds[-1])
        rest = t
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _link(jobs: DataFrame, kind: str) -> DataFrame:
    """(node, links, root) sums of each job."""
    import pyarrow as pa
    ship(jobs.sparkSession)
    keys = ["dim", "f", "lo", "hi"]

    def run(batches):
        for t, bounds in _runs(batches, keys):
            dim, f, lo, hi, block, n = (t.column(c).to_numpy() for c in [*keys, "block", "n"])
            x, lists, node = t.column("x"), t.column("filters"), t.column("node")
            cols: list = [], [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if z - a < 2:
                    continue
                raw = np.frombuffer(b"".join(x.slice(a, z - a).to_pylist()), kind).reshape(z - a, dim[a])
                own = lists.slice(a, z - a).combine_chunks()
                own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
                ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))
                got = linked(_unit(raw), n[a:z], np.split(own.flatten().to_numpy(), ends[:-1]), f[a], block[a:z] if lo[a] < hi[a] else None)
                if got is None:
                    continue
                names = node.slice(a, z - a).to_pylist()
                for k in np.flatnonzero(got[0]).tolist():
                    for c, v in zip(cols, (names[k], int(got[0][k]), names[got[1][k]])):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["node", "links", "root"])

    return jobs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node string, links bigint, root string")


def similar_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    v = vectors.select("vec_id", F.col("embedding").cast(f"array<{'float' if kind == 'float32' else 'double'}>").alias("embedding"))
    fine = F.expr("embedding IS NOT NULL AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < float('infinity')) AND exists(embedding, e -> e <> 0)")
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn(
        "node", F.when(F.col("fine"), F.concat_ws("-", F.xxhash64("embedding").cast("string"), F.xxhash64(F.lit(7), "embedding").cast("string"))))
    classes = put(v.where("fine").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "classes")
    assigned = put(_assign(classes, kind), "filters").withColumn("f", F.explode("filters"))
    # written, so that its size is known before the rows are dealt: only directions of several blocks
    crowded = put(assigned.groupBy("dim", "f").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("dim", "f", F.ceil(F.col("m") / BLOCK).alias("nb")), "crowded")
    jobs = assigned.join(crowded, ["dim", "f"], "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("bigint")))
    jobs = jobs.withColumn("filters", F.expr("filter(filters, g -> g < f)")).withColumn("block", F.pmod(F.xxhash64("node", "f"), "nb"))
    jobs = jobs.withColumn("peer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    found = put(_link(jobs.select("dim", "f", F.least("block", "peer").alias("lo"), F.greatest("block", "peer").alias("hi"), "block", "node", "n", "x", "filters"), kind), "links")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = classes.select("node", "rep", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(comp, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    own = own.join(own.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = v.where("fine").join(own, "node").select("vec_id", "n_links", "component_id").unionByName(
        v.where("NOT fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
