"""Stream with a quarantine (R3): a broken file or source leaves the others running.

The stream carries file names (``binaryFile`` without its content). A micro-batch reads its files with the
declared schema and processes them together. If that fails, every source's files are probed by a job of
their own, and the files of a failing source one by one; what can't be read (no such format, a cut file, a column
of another type) goes to the quarantine table with its source and the error, and the rest of
the batch is processed again, which overwrites what the failed attempt wrote. Records
of text formats that don't fit the schema are kept with their raw text in the same place. A failure that no
file explains is raised.

The probing loop runs over the files of one micro-batch only (``max_files``), and only after a failure.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.messages import MESSAGE_SCHEMA
from .scan_stream import process_batch

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# a failing task reaches Python as either
FAILURES = (PySparkException, Py4JJavaError)
QUARANTINE_SCHEMA = "source STRING, path STRING, error STRING, record STRING"
CORRUPT = "_corrupt_record"


def read_file_stream(spark: SparkSession, path: str, max_files: int = 1000, glob: str = "*") -> DataFrame:
    """Landed files as (path, length), new ones per micro-batch; folders below are searched, too."""
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(max_files)).load(path).select("path", "length"))


def source_of(path: str, root: str) -> str:
    """The first folder below the landing root ('' for files that lie in it)."""
    inner = re.sub(r"^[a-z0-9]+:/*", "/", path)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    rest = inner[len(base):] if inner.startswith(base) else inner
    return rest.split("/", 1)[0] if "/" in rest else ""


def read_files(spark: SparkSession, paths: list[str], fmt: str, schema: str) -> DataFrame:
    r = spark.read.format(fmt).option("recursiveFileLookup", "true")
    if fmt in ("json", "csv"):
        r = r.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    else:
        r = r.schema(schema)
    rows = r.load(paths)
    if CORRUPT in rows.columns:
        # a parser checks the columns that are asked for; ask for all, so a record is right or wrong everywhere
        whole = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != CORRUPT]))
        rows = rows.where(F.length(whole) >= 0)
    return rows


def reason(e: Exception) -> str:
    """The first line of an error and of what caused it."""
    if not isinstance(e, Py4JJavaError):
        return str(e).strip().splitlines()[0][:500]
    own = cause = e.java_exception
    while cause.getCause() is not None:
        cause = cause.getCause()
    lines = [str(x.getMessage() or x.getClass().getName()).strip().splitlines()[0] for x in ([own] if own == cause else [own, cause])]
    return ": ".join(lines)[:500]


def error_of(spark: SparkSession, paths: list[str], fmt: str, schema: str) -> str | None:
    """The first line of the error that reading these files whole gives; None if they can be read."""
    try:
        read_files(spark, paths, fmt, schema).write.format("noop").mode("overwrite").save()
    except FAILURES as e:
        return reason(e)
    return None


def broken_files(spark: SparkSession, by_source: dict[str, list[str]], fmt: str, schema: str) -> list[tuple]:
    """(source, path, error, None) of every file that can't be read."""
    out = []
    for source, paths in sorted(by_source.items()):
        if error_of(spark, paths, fmt, schema) is None:
            continue
        for p in sorted(paths):
            error = error_of(spark, [p], fmt, schema)
            if error is not None:
                out.append((source, p, error, None))
    return out


def process_files(files: DataFrame, batch_id: int, *, root: str, quarantine_path: str, fmt: str = "parquet",
                  schema: str = MESSAGE_SCHEMA, **kw) -> None:
    """One micro-batch of file names. ``kw`` goes to ``process_batch``."""
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").collect()]
    by_source: dict[str, list[str]] = {}
    for p in paths:
        by_source.setdefault(source_of(p, root), []).append(p)
    bad: list[tuple] = []
    try:
        _process(spark, paths, batch_id, fmt, schema, kw)
    except FAILURES:
        bad = broken_files(spark, by_source, fmt, schema)
        if not bad:
            raise
        gone = {b[1] for b in bad}
        _process(spark, [p for p in paths if p not in gone], batch_id, fmt, schema, kw)
    out = spark.createDataFrame(bad, QUARANTINE_SCHEMA)
    good = [p for p in paths if p not in {b[1] for b in bad}]
    if fmt in ("json", "csv") and good:
        rows = read_files(spark, good, fmt, schema).withColumn("path", F.col("_metadata.file_path"))
        wrong = rows.where(F.col(CORRUPT).isNotNull())
        first = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")) + "/", "")
        source = F.when(F.instr(first, "/") > 0, F.substring_index(first, "/", 1)).otherwise("")
        out = out.unionByName(wrong.select(source.alias("source"), "path", F.lit("record doesn't fit the schema").alias("error"), F.col(CORRUPT).alias("record")))
    out.write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")


def _process(spark: SparkSession, paths: list[str], batch_id: int, fmt: str, schema: str, kw: dict) -> None:
    if not paths:
        rows = spark.createDataFrame([], schema)
    else:
        rows = read_files(spark, paths, fmt, schema)
        if CORRUPT in rows.columns:
            rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    process_batch(rows, batch_id, **kw)


def start_isolated_stream(spark: SparkSession, landing: str, *, quarantine_path: str, checkpoint_path: str, fmt: str = "parquet",
                          schema: str = MESSAGE_SCHEMA, max_files: int = 1000, glob: str = "*", trigger: dict | None = None, **kw):
    """R1-R4 over the files below ``landing``, one folder a source."""
    def fn(df, i):
        process_files(df, i, root=landing, quarantine_path=quarantine_path, fmt=fmt, schema=schema, **kw)

    return (read_file_stream(spark, landing, max_files, glob).writeStream.foreachBatch(fn)
            .option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"processingTime": "5 minutes"})).start())
