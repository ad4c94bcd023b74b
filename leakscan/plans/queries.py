"""Registered queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame)``.

Each query reads the driver tables (or data Spark derives from them) in
full. Oracles with the same column names live in ``oracle_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..operators.analyze import scan_and_score
from ..operators.detect import explode_fields, with_raw_findings
from . import fixtures as FX

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def leaks_text(arr_col: str = "findings"):
    return F.array_join(F.transform(F.col(arr_col), lambda f: F.concat_ws(
        ":", f["pos"].cast("string"), f["type"], f["confidence"].cast("string"), f["value"])), "; ")


def scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message keys, whole text and model score of every message."""
    return FX.landed(spark, sf_dir).select("chat_id", "message_id", "text", "model_score")


@register("scan_score")
def q_scan_score(spark, sf_dir):
    """F1 + F10 + F11 + C12 on every message: raw/kept counts, kept findings, score."""
    out = scan_and_score(scan_source(spark, sf_dir))
    return out.select("chat_id", "message_id",
                      F.size("raw_findings").cast("bigint").alias("n_raw"),
                      F.size("findings").cast("bigint").alias("n_kept"),
                      leaks_text().alias("leaks"),
                      F.col("sx_score"))


def _detect_query(det: C.Detector):
    def fn(spark, sf_dir):
        df = with_raw_findings(scan_source(spark, sf_dir), detectors=[det])
        return explode_fields(df, ["chat_id", "message_id"], "raw_findings", {
            "position": lambda e: e["pos"].cast("bigint"), "full_value": lambda e: e["full"],
            "value": lambda e: e["value"], "confidence": lambda e: e["confidence"].cast("double")})
    fn.__doc__ = f"D{det.no + 1}: every {det.name} finding (after length/whitelist filters)."
    return fn


for _d in C.DETECTORS:
    REGISTRY[f"detect_{_d.name}"] = _detect_query(_d)
