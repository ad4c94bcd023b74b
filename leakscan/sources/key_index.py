"""Index of alerted message keys, by bucket (R2).

A micro-batch must know which of its candidates already have an alert. The alert table grows without
end and holds texts; the index holds two numbers an alert and the bucket of their hash.

Layout: ``base=<i>`` (a compacted state: all keys of batches up to i) and ``delta=<i>`` (the keys of
batch i). A folder of few keys is one file; one of many is cut into slices by the bucket,
``slices=<n>/slice=<s>``, of about ``SLICE_KEYS`` keys each, at most ``BUCKETS`` of them. So a batch opens a
file for each batch since the base, and of a large folder those slices alone that its own
candidates fall into: the partition filter is a list of slice numbers. (Folders of earlier versions have
``bucket=<b>`` below them and are read likewise.)

A batch overwrites its own delta, so a replay writes the same keys once; it reads the newest
base below it and the deltas between. Every ``COMPACT`` batches (``COMPACT_SMALL`` as long as the base is one
file) a new base is written from the last one and its deltas, before the batch itself. A
folder counts only when its ``_SUCCESS`` marker stands, so a base that a lost driver left half-written is
ignored and written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["chat_id", "message_id"]
BUCKETS = 1024
COMPACT = 100
#: A base of one file costs little to write anew, and so few folders are listed without a Spark job.
COMPACT_SMALL = 24
SLICE_KEYS = 1 << 18
SCHEMA = "chat_id bigint, message_id bigint, bucket int"


def bucket_of(*keys) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("bigint") for k in keys]), F.lit(BUCKETS)).cast("int")


def _names(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(root)] if fs.exists(root) else []


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind."""
    return sorted(int(name[len(kind) + 1:]) for name in _names(spark, path)
                  if name.startswith(f"{kind}=") and "_SUCCESS" in _names(spark, f"{path}/{name}"))


def _cut(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """Column and number of the folder's partitions; None: its keys lie in one place."""
    for name in _names(spark, folder):
        if name.startswith("slices="):
            return "slice", int(name[len("slices="):])
        if name.startswith("bucket="):
            return "bucket", BUCKETS
    return None


def _parts(spark: SparkSession, path: str, batch_id: int) -> tuple[list[str], int]:
    """Folders that hold the keys of all batches before ``batch_id``; and the number of the base."""
    base = max((b for b in _folders(spark, path, "base") if b < batch_id), default=-1)
    deltas = [d for d in _folders(spark, path, "delta") if base < d < batch_id]
    return ([f"{path}/base={base}"] if base >= 0 else []) + [f"{path}/delta={d}" for d in deltas], base


def known(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the index holds anything of earlier batches."""
    return bool(_parts(spark, path, batch_id)[0])


def _read(spark: SparkSession, folders: list[str], buckets: list[int] | None) -> DataFrame | None:
    """Keys of the folders; with ``buckets`` only those of theirs, from the partitions that hold them."""
    cut = {f: _cut(spark, f) for f in folders}
    whole = [f for f in folders if cut[f] is None]
    frames = [spark.read.schema(SCHEMA).parquet(*whole)] if whole else []
    for f in folders:
        if cut[f] is not None:
            column, n = cut[f]
            df = spark.read.schema(SCHEMA + (", slices int, slice int" if column == "slice" else "")).parquet(f)
            if buckets is not None:
                df = df.where(_among(column, {b % n for b in buckets}))
            frames.append(df.select("chat_id", "message_id", "bucket"))
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out if out is None or buckets is None else out.where(_among("bucket", buckets))


def _among(column: str, numbers) -> F.Column:
    return F.expr(f"{column} IN ({', '.join(map(str, sorted(numbers)))})" if numbers else "false")


def write_keys(keys: DataFrame, path: str, batch_id: int) -> None:
    """The keys that batch ``batch_id`` alerted; a replay overwrites them."""
    _write(keys, f"{path}/delta={batch_id}", keys.count())


def _write(keys: DataFrame, folder: str, rows: int) -> None:
    """``rows``: the number of keys, or a number not below it."""
    out = keys.select(*[F.col(k).cast("bigint").alias(k) for k in KEYS]).withColumn("bucket", bucket_of(*KEYS))
    slices = min(BUCKETS, 1 << max(0, -(-rows // SLICE_KEYS) - 1).bit_length())
    if slices == 1:
        out.coalesce(1).sortWithinPartitions("bucket", *KEYS).write.mode("overwrite").parquet(folder)
        return
    # all rows of a slice go to one writer: a file a slice, sorted
    (out.withColumn("slices", F.lit(slices)).withColumn("slice", F.col("bucket") % slices)
        .repartition("slice").sortWithinPartitions("slice", "bucket", *KEYS)
        .write.mode("overwrite").partitionBy("slices", "slice").parquet(folder))


def compact(spark: SparkSession, path: str, batch_id: int) -> None:
    """A base of all keys of the batches before ``batch_id``, if there are ``COMPACT`` deltas or more
    (``COMPACT_SMALL`` if there is no base in slices)."""
    folders, base = _parts(spark, path, batch_id)
    deltas = len(folders) - (base >= 0)
    if deltas < min(COMPACT, COMPACT_SMALL) or deltas < COMPACT and base >= 0 and _cut(spark, folders[0]):
        return
    keys = _read(spark, folders, None).select(*KEYS)
    _write(keys.distinct(), f"{path}/base={batch_id - 1}", keys.count())
    # what the new base holds is of no more use
    jvm = spark._jvm
    for f in folders:
        old = jvm.org.apache.hadoop.fs.Path(f)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def ensure(spark: SparkSession, path: str, batch_id: int, alerted: DataFrame | None) -> None:
    """An index for a table that has none (an older one, or a lost index): a base of ``alerted``, the
    keys of all earlier batches. Read once; later batches read the index."""
    if alerted is not None and not known(spark, path, batch_id):
        _write(alerted.select(*KEYS).distinct(), f"{path}/base={batch_id - 1}", alerted.count())


def without_known(cands: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Candidates (already written, they are read twice) whose key no batch before ``batch_id`` alerted."""
    spark = cands.sparkSession
    folders, _ = _parts(spark, path, batch_id)
    if not folders:
        return cands
    hit = None
    if any(_cut(spark, f) for f in folders):
        hit = [r[0] for r in cands.select(bucket_of(*KEYS).alias("b")).distinct().collect()]
    known = _read(spark, folders, hit)
    return cands.join(known.select(*KEYS), KEYS, "left_anti")
