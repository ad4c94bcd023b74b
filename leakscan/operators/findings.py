"""Finding ordering and the greedy dedup fold.

The fold is order dependent (a rejected finding does not mark its type
as seen, so a later one of the same type may still be kept), so it is a
left fold over the sorted array of one message:

    sorted by (-rank, -confidence, catalog order, position)
    keep f  iff  no kept finding has f's type
            and  no kept finding of f's group overlaps f

The "replace" branches of a naive reading can never fire on sorted input
(a kept finding never ranks lower, and one type has one rank), so the
fold above is the whole rule. At most one finding per type is kept, so
each step looks at <= 27 kept entries. It runs per row, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C


def rank_findings(arr: Column) -> Column:
    """stable order by rank desc, confidence desc (struct order does it)."""
    return F.array_sort(arr)


def overlaps(a: Column, b: Column) -> Column:
    """start distance < 50; a position of 0 means "unknown" and then
    the two overlap when in one group with confidences closer than 0.3.
    The confidence gap is compared in DOUBLE, as binary floats compare."""
    unknown = (a["pos"] == 0) | (b["pos"] == 0)
    gap = F.abs(a["confidence"].cast("double") - b["confidence"].cast("double"))
    return F.when(unknown, (a["grp"] == b["grp"]) & (gap < F.lit(C.OVERLAP_CONFIDENCE_GAP))) \
        .otherwise(F.abs(a["pos"] - b["pos"]) < C.OVERLAP_DISTANCE)


def dedup_fold(sorted_arr: Column, elem_type: str) -> Column:
    """F8 + F10: the greedy fold over already ranked findings."""
    zero = F.array().cast(elem_type)

    def step(kept, f):
        seen_type = F.exists(kept, lambda k: k["type"] == f["type"])
        clash = F.exists(kept, lambda k: (k["grp"] == f["grp"]) & overlaps(k, f))
        return F.when(seen_type | clash, kept).otherwise(F.concat(kept, F.array(f)))

    return F.aggregate(sorted_arr, zero, step)


def order_by_position(arr: Column) -> Column:
    """by position, ties in fold order."""
    tagged = F.transform(arr, lambda f, i: F.struct(f["pos"].alias("p"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(tagged), lambda x: x["f"])


def with_kept_findings(df: DataFrame, raw_col: str = "raw_findings", out_col: str = "findings") -> DataFrame:
    elem_type = df.schema[raw_col].dataType.simpleString()
    return df.withColumn(out_col, order_by_position(dedup_fold(rank_findings(F.col(raw_col)), elem_type)))


def public_findings(arr: Column) -> Column:
    """F6 output shape: the full value is dropped before findings leave."""
    return F.transform(arr, lambda f: F.struct(
        f["type"].alias("type"), f["value"].alias("value"),
        f["confidence"].alias("confidence"), f["severity"].alias("severity"),
        f["pos"].alias("position"), f["priority"].alias("priority")))


def type_group_col(t: Column) -> Column:
    """type -> group, else the type itself."""
    m = F.create_map(*[x for k, v in C.TYPE_GROUP.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, t), t)


def type_rank_col(t: Column) -> Column:
    """type -> rank, else 0."""
    m = F.create_map(*[x for k, v in C.TYPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, t), F.lit(0))
