"""Best OCR candidate per image (X10, X11) as a group-wise arg-max.

Candidate texts come from an OCR engine outside Spark (one row per image,
preprocessing variant and parameter set). Selection is a hash aggregate
with partial (map-side) aggregation: ``max_by`` over a total order, so a
hot image never holds more than one running best per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.regex import ustrip
from ..functions.text import correct_ocr_text, ocr_candidate_quality, ocr_normalize_text


def gate_candidates(cands: DataFrame) -> DataFrame:
    """X11: reads of images smaller than 50 px on a side are skipped."""
    return cands.where((F.col("height") >= C.OCR_MIN_SIDE) & (F.col("width") >= C.OCR_MIN_SIDE))


def score_candidates(cands: DataFrame) -> DataFrame:
    """X7 + X8 + X9 per candidate read: cleaned text and its quality."""
    t = correct_ocr_text(ocr_normalize_text(ustrip(F.col("text"))))
    return (cands.withColumn("clean", t)
                 .withColumn("quality", ocr_candidate_quality(F.col("clean"))))


def best_ocr_text(images: DataFrame, cands: DataFrame, base: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image the cleaned text of the best read (quality > 0; ties ->
    earliest variant, then parameter set); else the corrected base read;
    else the 'not recognised' sentinel. Every image of ``images`` is kept."""
    scored = score_candidates(gate_candidates(cands))
    # reads that do not qualify get a null ordering key, which max_by skips;
    # a Filter here would be pushed below the cleaning projection and
    # re-evaluate the cleaning regexes inside the predicate
    ok = (F.col("clean") != "") & (F.col("quality") > 0)
    order = F.when(ok, F.struct(F.col("quality"), -F.col("variant_no"), -F.col("param_no")))
    best = scored.groupBy(key).agg(F.max_by("clean", order).alias("best"))
    base_txt = base.select(key, correct_ocr_text(ustrip(F.col("text"))).alias("base_text"))
    out = (images.select(key).join(best, key, "left").join(base_txt, key, "left"))
    txt = F.coalesce(F.when(F.col("best") != "", F.col("best")),
                     F.when(F.col("base_text") != "", F.col("base_text")),
                     F.lit(C.OCR_NOT_RECOGNISED))
    return out.select(key, txt.alias("ocr_text"))
