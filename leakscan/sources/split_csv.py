"""Quoted CSV with line breaks inside fields, read in parallel.

Spark reads such a file (``multiLine``) as one task, because a split can't tell whether its first line lies
inside a quoted field. Here a file is read as lines, in as many tasks as its size allows, and the
question is answered for all splits at once:

1. Each line says where it leads: whether it ends inside a field if it begins outside (``out``), and if
   it begins inside (``ins``). Both are regular expressions of one pass.
2. Each split runs both cases through its lines: per line the state before and after, and the records that
   ended before it, in either case.
3. One row a split is combined along the file: the state at its start, and the number of its first record.
4. Lines that are whole records are parsed in place; the few others meet by record number and are joined.

Records are parsed with ``from_csv``: rows whose number of fields differs from the schema's are dropped, as
``DROPMALFORMED`` does. A field that is never closed makes the rest of its file one record, as it does for Spark's reader.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

CORRUPT = "_corrupt_record"


def _patterns(sep: str, quote: str, escape: str) -> tuple[str, str]:
    """Java patterns: a line that begins outside a field ends inside one; the same for one that
    begins inside. Closing quotes end a field; what stands behind them up to the separator belongs to it.
    Possessive repetitions, so a line is read once."""
    s, q, e = (f"\\x{ord(c):02x}" for c in (sep, quote, escape))
    inner = f"(?:[^{q}]|{q}{q})*+" if escape == quote else f"(?:[^{q}{e}]|{e}(?:[{q}{e}]|(?=[^{q}{e}]|$)))*+"
    # a field and its separator: quoted and closed, or not beginning with a quote
    field = f"(?:{q}{inner}{q}[^{s}]*+{s}|[^{q}{s}][^{s}]*+{s}|{s})"
    rest = f"{field}*+{q}{inner}$"
    return f"(?s)^{rest}", f"(?s)^{inner}(?:$|{q}[^{s}]*+{s}{rest})"


def _lines(spark: SparkSession, path: str, sep: str, quote: str, escape: str) -> DataFrame:
    """file, block (start of the split), seq (order within it), value, and per case (0: the split
    begins outside a field, 1: inside) the state before and after the line and the records that ended before it."""
    import pyarrow as pa
    ship_package(spark)
    out, ins = _patterns(sep, quote, escape)
    text = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    moves = text.select("*", F.col("value").rlike(out).alias("out"), F.col("value").rlike(ins).alias("ins"))

    def run(batches):
        split, states, ended, seq = None, [0, 1], [0, 0], 0
        for b in batches:
            n = b.num_rows
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            a, c = b.column("out").to_pylist(), b.column("ins").to_pylist()
            cols = {k: np.zeros(n, np.int64) for k in ("seq", "b0", "a0", "e0", "b1", "a1", "e1")}
            for i in range(n):
                if (files[i], blocks[i]) != split:
                    split, states, ended, seq = (files[i], blocks[i]), [0, 1], [0, 0], 0
                cols["seq"][i] = seq
                seq += 1
                for k in (0, 1):
                    cols[f"b{k}"][i], cols[f"e{k}"][i] = states[k], ended[k]
                    states[k] = int(c[i] if states[k] else a[i])
                    cols[f"a{k}"][i] = states[k]
                    ended[k] += 1 - states[k]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), b.column("value"), *[pa.array(v) for v in cols.values()]],
                                             names=["file", "block", "value", *cols])

    return moves.mapInArrow(run, "file string, block bigint, value string, seq bigint, b0 bigint, a0 bigint, e0 bigint, b1 bigint, a1 bigint, e1 bigint")


def _splits(lines: DataFrame) -> DataFrame:
    """file, block -> begins (state at its start), base (records of the file that ended before it).
    A row a split; the combination runs over the splits of one file."""
    per = lines.groupBy("file", "block").agg(
        F.max_by("a0", "seq").alias("t0"), F.max_by("a1", "seq").alias("t1"),
        F.sum(1 - F.col("a0")).alias("n0"), F.sum(1 - F.col("a1")).alias("n1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the state after a run of splits: what the last split that leads to one state from both decides, and
    # the number of splits after it that turn the state around
    turns = F.when((F.col("t0") == 1) & (F.col("t1") == 0), 1).otherwise(0)
    fixed = F.when(F.col("t0") == F.col("t1"), F.struct(F.col("block").alias("at"), F.col("t0").alias("state"), F.sum(turns).over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)).alias("turned")))
    s = per.withColumn("_fixed", fixed).withColumn("_last", F.last("_fixed", ignorenulls=True).over(before)) \
        .withColumn("_turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    begins = F.pmod(F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_turned") - F.coalesce(F.col("_last.turned"), F.lit(0)), F.lit(2))
    s = s.withColumn("begins", begins)
    own = F.when(F.col("begins") == 0, F.col("n0")).otherwise(F.col("n1"))
    return s.select(F.col("file").alias("of"), F.col("block").alias("at"), "begins", F.coalesce(F.sum(own).over(before), F.lit(0)).alias("base"))


def read_records(spark: SparkSession, path: str, sep: str = ";", quote: str = '"', escape: str = '"') -> DataFrame:
    """file, record (number in the file, from 0), value (the whole record, its line breaks in it)."""
    lines = _lines(spark, path, sep, quote, escape)
    x = lines.join(_splits(lines), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    at = F.col("begins") == 0
    x = x.select("file", "block", "seq", "value",
                 (F.col("base") + F.when(at, F.col("e0")).otherwise(F.col("e1"))).alias("record"),
                 (F.when(at, F.col("b0") + F.col("a0")).otherwise(F.col("b1") + F.col("a1")) == 0).alias("whole"))
    one = x.where("whole").select("file", "record", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "value")))
    more = x.where("NOT whole").groupBy("file", "record").agg(F.concat_ws("\n", F.transform(parts, lambda p: p["value"])).alias("value"))
    both = one.unionByName(more)
    # the carriage return of a record's own end is no part of it
    return both.select("file", "record", F.regexp_replace("value", "\r$", "").alias("value"))


def read_split_csv(spark: SparkSession, path: str, columns: list[str], header: bool, options: dict) -> DataFrame:
    """All records as string ``columns``; the first record of each file is left out if it is a ``header``."""
    sep, quote, escape = options["sep"], options["quote"], options["escape"]
    rows = read_records(spark, path, sep, quote, escape).where("length(value) > 0")
    if header:
        rows = rows.where("record > 0")
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, CORRUPT])
    opts = {**{k: v for k, v in options.items() if k not in ("mode", "encoding")}, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = rows.select(F.from_csv("value", schema, opts).alias("r")).select("r.*")
    return parsed.where(F.col(CORRUPT).isNull()).select(*[F.col(f"`{c}`") for c in columns])
