"""Training CSV source (S6) and model persistence."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split_csv import read_split_csv

TRAINING_COLUMNS = ["id", "text", "label", "category", "comment"]


def csv_options(escape: str = '"') -> dict:
    return {"sep": ";", "quote": '"', "escape": escape, "multiLine": "true", "encoding": "UTF-8",
            "mode": "DROPMALFORMED"}


def _unwrap_doubled(c):
    """A field quoted with doubled inner quotes that a backslash-escape parse
    returned raw: strip the outer quotes and collapse "" to "."""
    wrapped = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when(wrapped, F.regexp_replace(inner, '""', '"')).otherwise(c)


def read_training_csv(spark: SparkSession, path: str, escape: str = '"') -> DataFrame:
    """S6: ';'-separated, quoted, UTF-8, malformed rows dropped. With a header
    the named columns are used; a file whose header lacks text/label is read
    positionally as id, text, label, category, comment.

    ``escape='"'`` reads doubled quotes, ``escape='\\'`` backslash-escaped
    quotes; ``escape='auto'`` accepts both in one file (backslash parse, then
    single-line doubled-quote fields are unwrapped).

    A file is read by as many tasks as its size allows, though fields may hold
    line breaks (``split_csv``); only the header is read ahead."""
    auto = escape == "auto"
    opts = csv_options("\\" if auto else escape)
    head = spark.read.options(**opts).option("header", "true").csv(path).columns
    named = {"text", "label"} <= set(head)
    df = read_split_csv(spark, path, head if named else TRAINING_COLUMNS, named, opts)
    if auto:
        df = df.select(*[_unwrap_doubled(F.col(c)).alias(c) for c in df.columns])
    return df


def write_training_csv(df: DataFrame, path: str, escape: str = '"') -> None:
    opts = {k: v for k, v in csv_options(escape).items() if k not in ("mode", "multiLine")}
    df.write.mode("overwrite").options(**opts).option("header", "true").csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a fitted pipeline; an absent model gives None (scores 0), an
    unreadable one is an error."""
    from pyspark.ml import PipelineModel
    try:
        SparkSession.active().read.text(f"{path}/metadata")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(path)
