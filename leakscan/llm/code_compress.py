"""Vector codes by exact integer product quantisation.

Components become integers floor(4096 x); vectors are cut into 8 consecutive parts; each part
gets a codebook of 16 entries by Lloyd rounds in integer arithmetic. Squared distances are
|v|^2 - 2 v.c + |c|^2. The dot products of a batch with a codebook are matrix products:
integers are broken into limbs so small that no float64 product sum reaches 2^53, each
pair of limbs goes through BLAS exactly, and the products are put together in int64.
``argmin`` takes the first of equal distances. No result depends on the order of rows or
on how tasks are cut, so lost tasks are simply run again.

Each round reads the written integers, sums the parts of each entry in the tasks, then by entry
(at most 16 entries x the vector length rows a task), and brings the new entries to
the driver: 16 integers per component, whatever the number of vectors.

Defined results: null vectors and vectors with null or non-finite components are dropped. Vectors of another
length are a space of their own, with its own codebooks (the lengths of a table are few; the
codebooks of all lengths lie in the driver); a length that 8 doesn't divide gives the first
parts one component more; empty vectors have code 00 x 8. Of equal vec_ids the smaller vector
comes first; a null vec_id comes last. With less than 16 vectors a codebook has less entries.
Repeated rows count as often as they come. Integers too large for distances in int64
(``safe``) are computed with Python's integers; an error beyond 63 bits fails the job. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, ship

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``x`` as ``count`` float64 matrices with sum(limb << (bits * k)) == x; the last one
    carries the sign, the others lie in 0 .. 2^bits - 1."""
    out = []
    for _ in range(count - 1):
        out.append((x & np.int64((1 << bits) - 1)).astype(np.float64))
        x = x >> np.int64(bits)
    return [*out, x.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T of int64 matrices, exact modulo 2^64."""
    d = a.shape[1]
    if not d:
        return np.zeros((len(a), len(b)), np.int64)
    if bits is None:
        bits = (53 - max(1, d - 1).bit_length()) // 2 - 1
    top = max(1, int(max(a.max(initial=0), -a.min(initial=0), b.max(initial=0), -b.min(initial=0))))
    count = -(-(top.bit_length()) // bits)
    la, lb = limbs(a, bits, count), limbs(b, bits, count)
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(la):
        for j, y in enumerate(lb):
            shift = bits * (i + j)
            if shift < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(shift)
    return out


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``v`` to all rows of ``c``."""
    if v.dtype == object or c.dtype == object:
        return ((v[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(2)
    return (v * v).sum(1)[:, None] - 2 * exact_dot(v, c) + (c * c).sum(1)[None, :]


def safe(d: int) -> int:
    """Largest size of integers whose squared distance over ``d`` components stays below 2^63."""
    return math.isqrt((1 << 61) // max(1, d)) - 1


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """Edges of the parts."""
    return [dim // parts * k + min(k, dim % parts) for k in range(parts + 1)]


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); Python integers where int64 distances would not hold them."""
    y = np.floor(values.astype(np.float64) * scale)
    if y.size and np.abs(y).max() > safe(-(-y.shape[1] // PARTS)):
        return np.array([[int(x) for x in row] for row in y], object).reshape(y.shape)
    return y.astype(np.int64)


def _spaces(b: pa.RecordBatch):
    """Per vector length: the rows of the batch with it, and their integers as a matrix."""
    col = b.column("v")
    n = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    offs = np.cumsum(n) - n
    for d in np.unique(n).tolist():
        rows = np.flatnonzero(n == d)
        yield d, rows, flat[(offs[rows][:, None] + np.arange(d)).reshape(-1)].reshape(len(rows), d)


def _narrow(c: list) -> np.ndarray:
    big = any(abs(x) > safe(len(row)) for row in c for x in row)
    return np.array(c, object if big else np.int64).reshape(len(c), -1)


def assign(v: np.ndarray, books: list) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row and part; ``books``: entries of each part."""
    edges = cuts(v.shape[1], len(books))
    code = np.zeros((len(v), len(books)), np.int64)
    err = np.zeros((len(v), len(books)), object if v.dtype == object else np.int64)
    for k, c in enumerate(books):
        d = distances(v[:, edges[k]:edges[k + 1]], _narrow(c))
        code[:, k] = d.argmin(1)
        err[:, k] = d[np.arange(len(v)), code[:, k]]
    return code, err


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of float64 integers; beyond 2^53 they are still exact multiples)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("bigint"), "label", x.alias("v"))


def _first_entries(v: DataFrame, entries: int) -> dict:
    """Vector length -> the vectors of the smallest vec_ids, as integers. A window limit: each
    task keeps ``entries`` rows of a length."""
    from pyspark.sql import Window
    w = Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    out: dict = {}
    for r in v.select("v", F.row_number().over(w).alias("r")).where(F.col("r") <= entries).orderBy("r").collect():
        out.setdefault(len(r.v), []).append([int(np.floor(x * SCALE)) for x in r.v])
    return out


def _round(v: DataFrame, books: dict) -> dict:
    """Codebooks after one round: every entry becomes the floored mean of its parts."""
    schema = "dim int, part int, entry int, place int, total decimal(38,0), n bigint"

    def run(batches):
        sums: dict = {}
        for b in batches:
            for d, _, x in _spaces(b):
                x = integers(x)
                code, _ = assign(x, books[d])
                edges = cuts(d)
                for k in range(PARTS):
                    part = x[:, edges[k]:edges[k + 1]]
                    for e in np.unique(code[:, k]).tolist():
                        own = part[code[:, k] == e]
                        total, n = sums.get((d, k, e), (0, 0))
                        sums[d, k, e] = total + own.sum(0).astype(object), n + len(own)
        from decimal import Decimal
        rows = [(d, k, e, i, Decimal(int(t)), n) for (d, k, e), (total, n) in sorted(sums.items()) for i, t in enumerate(total)]
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.int32()] * 4 + [pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["dim", "part", "entry", "place", "total", "n"])

    new = {d: [[list(e) for e in book] for book in own] for d, own in books.items()}
    got = v.select("v").mapInArrow(run, schema).groupBy("dim", "part", "entry", "place").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    for r in got.collect():
        new[r.dim][r.part][r.entry][r.place] = int(r.t) // r.n
    return new


def codebooks_digest(books: dict) -> str:
    """sha256 of all entries by length, part, entry and place."""
    return hashlib.sha256(",".join(str(x) for d in sorted(books) for book in books[d] for e in book for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, dict]:
    """``vectors`` (vec_id, embedding, label) -> (vec_id, label, code, error) and the codebooks
    {length: [part: [entry: [component]]]}. ``code`` holds two hex digits a part."""
    spark = vectors.sparkSession
    ship(spark)
    v = put(_prepared(vectors), "vectors")
    books = {}
    for d, first in _first_entries(v, entries).items():
        edges = cuts(d)
        books[d] = [[e[edges[k]:edges[k + 1]] for e in first] for k in range(PARTS)]
    for _ in range(rounds if books else 0):
        books = _round(v, books)

    def run(batches):
        for b in batches:
            code = np.empty(b.num_rows, object)
            error = np.zeros(b.num_rows, object)
            for d, rows, x in _spaces(b):
                c, err = assign(integers(x), books[d])
                code[rows] = [bytes(r).hex() for r in c.astype(np.uint8)]
                error[rows] = err.sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    label = v.schema["label"].dataType.simpleString()
    return v.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint"), books


def with_label_error(coded: DataFrame, books: dict) -> DataFrame:
    """vec_id, code, error, the error of the row's label (null labels together) and the digest of
    the codebooks. The codes are written once, then summed and joined: sums combine
    in the tasks; the sums of the labels are broadcast only where their measured size
    allows, else a label with many rows is split by the adaptive join."""
    c = put(coded, "codes")
    by = c.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return c.join(by, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
