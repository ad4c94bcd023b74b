"""Scan + dedup + score of a text column (the core of A1), one narrow stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import with_raw_findings
from .findings import with_kept_findings
from .scoring import final_score, model_score_col


def scan_and_score(df: DataFrame, text_col: str = "text", model_col: str | None = "model_score") -> DataFrame:
    """Adds ``raw_findings``, ``findings`` (kept, by position), ``model_score_eff``
    (DECIMAL, 0 for blank text) and ``sx_score`` (DOUBLE, 3 dp).
    """
    out = with_kept_findings(with_raw_findings(df, text_col))
    model = F.col(model_col) if model_col else F.lit(None)
    out = out.withColumn("model_score_eff", model_score_col(model, F.col(text_col)))
    return out.withColumn("sx_score", final_score(F.col("findings"), F.col("model_score_eff"),
                                                  F.coalesce(F.length(text_col), F.lit(0))))
