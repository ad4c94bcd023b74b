"""Golden rows: every detector, the position-0 rule, the fold and the score."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from golden_cases import GOLDEN
from leakscan.operators.analyze import scan_and_score


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for g in GOLDEN:
        rows.append((g[0], 0, g[1], Decimal("0")))
        rows.append((g[0], 1, g[1], Decimal("0.9")))
    df = spark.createDataFrame(rows, "id string, variant int, text string, model_score decimal(5,3)")
    out = scan_and_score(df).select("id", "variant", F.size("raw_findings").alias("n_raw"), "findings", "sx_score")
    return {(r.id, r.variant): r for r in out.collect()}


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(results, case):
    gid, _, n_raw, kept, s0, s9 = case
    r0, r9 = results[(gid, 0)], results[(gid, 1)]
    assert r0.n_raw == n_raw
    assert [(f.pos, f.type, str(f.confidence), f.value) for f in r0.findings] == kept
    assert r0.sx_score == pytest.approx(s0, abs=1e-12)
    assert r9.sx_score == pytest.approx(s9, abs=1e-12)


def test_every_detector_is_kept_somewhere():
    from leakscan.catalog import DETECTOR_NAMES
    seen = {k[1] for g in GOLDEN for k in g[3]}
    assert set(DETECTOR_NAMES) <= seen
