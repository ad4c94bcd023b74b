"""Spark queries against their independent DuckDB oracles on sf0.001
(the driver runs the same comparison on sf0.01). LEAKSCAN_ALL_ORACLES=1
checks every registered query; the default is a representative subset."""
import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, register_views

SUBSET = ["scan_score", "detect_passport_mention", "detect_fio", "detect_card_number", "detect_email",
          "dedup_findings", "final_score", "regex_score", "analyze_messages", "write_alerts", "recent_alerts_by_source",
          "upsert_source", "mark_processed", "parse_message_date", "safe_clean_text", "best_ocr_candidate",
          "stratified_split", "read_training_csv", "overlap_predicate", "context_boost", "stream_dedup_alerts"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("LEAKSCAN_ALL_ORACLES") else SUBSET


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    return v


def rows(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rs), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    register_views(duck, SF_SMALL)
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(ocols, res.fetchall())
