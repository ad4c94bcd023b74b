"""Risk score of one message (C1-C12), as an expression over its kept
findings array: no grouping, no shuffle.

All arithmetic is DECIMAL (every constant has at most 3 decimals), the
score is rounded half-up once at the end and cast to DOUBLE last. This is
deterministic and order independent; a binary-float implementation can
differ only where the exact value is a half-tie at the third decimal.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C

D = Decimal
MODEL_TYPE = "decimal(5,3)"
SUM_TYPE = "decimal(12,6)"
FINAL_TYPE = "decimal(16,8)"


def _dec(x) -> Column:
    return F.lit(D(str(x)))


def clamp01(c: Column) -> Column:
    return F.least(_dec("1"), F.greatest(_dec("0"), c))


def n_findings(f: Column) -> Column:
    return F.size(f)


def distinct_types(f: Column) -> Column:
    """C2 (computed, not used by the formula)."""
    return F.size(F.array_distinct(F.transform(f, lambda x: x["type"])))


def max_confidence(f: Column) -> Column:
    """C3."""
    return F.coalesce(F.array_max(F.transform(f, lambda x: x["confidence"])), F.lit(D("0.00")).cast("decimal(4,2)"))


def distinct_categories(f: Column) -> Column:
    """C4."""
    return F.size(F.array_distinct(F.transform(f, lambda x: x["grp"])))


def weighted_sum(f: Column) -> Column:
    """Sum of confidence x type weight."""
    return F.aggregate(f, F.lit(D("0")).cast(SUM_TYPE),
                       lambda acc, x: (acc + x["confidence"] * x["weight"]).cast(SUM_TYPE))


def category_bonus(n_cat: Column) -> Column:
    """C6."""
    return F.when(n_cat >= 3, _dec("0.40")).when(n_cat >= 2, _dec("0.25")).otherwise(_dec("0.00"))


def free_mail_bonus(f: Column, n_cat: Column) -> Column:
    """C7."""
    has = F.exists(f, lambda x: x["type"].isin(C.FREE_EMAIL_TYPES))
    return F.when(has & (n_cat >= 2), _dec("0.15")).otherwise(_dec("0.00"))


def count_bonus(n: Column) -> Column:
    """min(0.45, (n - 1) * 0.09); negative for n = 0 (clamped later)."""
    return F.least(_dec("0.45"), (n - 1).cast("decimal(6,0)") * _dec("0.09"))


def regex_score(f: Column) -> Column:
    """clamp01(max * 0.50 + weighted * 0.30 + bonuses)."""
    n = n_findings(f)
    n_cat = distinct_categories(f)
    s = (max_confidence(f) * _dec("0.50") + weighted_sum(f) * _dec("0.30")
         + category_bonus(n_cat) + free_mail_bonus(f, n_cat) + count_bonus(n))
    return clamp01(s).cast(SUM_TYPE)


def has_passport(f: Column) -> Column:
    return F.exists(f, lambda x: x["type"].contains("passport"))


def model_weight(f: Column, text_len: Column) -> Column:
    """C10."""
    w = F.when(F.size(f) == 0, _dec("0.20")).when(has_passport(f), _dec("0.40")).otherwise(_dec("0.35"))
    return F.when(text_len < 20, w * _dec("0.7")).otherwise(w * _dec("1.0")).cast("decimal(6,3)")


def document_bonus(f: Column, model: Column) -> Column:
    """C11."""
    return F.when(has_passport(f) & (model > _dec("0.8")), _dec("0.22")).otherwise(_dec("0.00"))


def final_score(f: Column, model: Column, text_len: Column) -> Column:
    """C1 + C12: DOUBLE rounded to 3 decimals.

    ``model`` is the model score as DECIMAL(5,3) (0 for blank text).
    """
    n = n_findings(f)
    s = (regex_score(f) * _dec("0.50") + model_weight(f, text_len) * model
         + document_bonus(f, model) + n.cast("decimal(6,0)") * _dec("0.01"))
    score = F.round(clamp01(s).cast(FINAL_TYPE), 3)
    zero_rule = (n == 0) & (model < _dec("0.5"))
    return F.when(zero_rule, F.lit(0.0)).otherwise(score.cast("double"))


def model_score_col(model: Column, text: Column) -> Column:
    """M1 part: blank text has model score 0; otherwise the given score."""
    from .detect import is_blank
    return F.when(is_blank(text), F.lit(D("0")).cast(MODEL_TYPE)).otherwise(F.coalesce(model.cast(MODEL_TYPE), F.lit(D("0")).cast(MODEL_TYPE)))
