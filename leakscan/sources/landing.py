"""Landing writer: messages as Parquet whose row groups hold a fixed number of bytes.

A scan can split a file at row groups only. The usual group of 128 MB is one task of
minutes for 27 detectors; groups of ``GROUP_BYTES`` let Spark cut files by
``spark.sql.files.maxPartitionBytes`` and the cores it has, so a scan gets as many tasks as the
data allows without a shuffle. The size counts encoded bytes, and text is nearly all of a message, so
many short or a few long texts make equal groups; a text longer than a group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GROUP_BYTES = 1 << 20
#: Rows between two looks at the size of the open group.
CHECK_ROWS = 8


def land_messages(msgs: DataFrame, path: str, mode: str = "append", group_bytes: int = GROUP_BYTES,
                  partition_by: str | None = None) -> None:
    """Write ``msgs`` (any columns) where they are: no shuffle, a file per task (and folder of
    ``partition_by``)."""
    w = msgs.write.mode(mode)
    ((w.partitionBy(partition_by) if partition_by else w)
         .option("parquet.block.size", group_bytes)
         .option("parquet.page.size", min(1 << 20, group_bytes))
         .option("parquet.page.size.row.check.min", CHECK_ROWS).option("parquet.page.size.row.check.max", 128)
         .option("parquet.block.size.row.check.min", CHECK_ROWS).option("parquet.block.size.row.check.max", 128)
         .parquet(path))


def read_landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed files with a declared schema."""
    return spark.read.schema(schema).parquet(path)
