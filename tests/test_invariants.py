"""Invariants of dedup and score on the sf0.001 messages."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leakscan.catalog import group_of
from leakscan.plans import fixtures as FX
from leakscan.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def scored(spark):
    from leakscan.operators.analyze import scan_and_score
    return scan_and_score(FX.msgs(spark, SF_SMALL)).select(
        "chat_id", "message_id", "raw_findings", "findings", "sx_score").collect()


def overlaps(a, b):
    if a.pos == 0 or b.pos == 0:
        return group_of(a.type) == group_of(b.type) and abs(float(a.confidence) - float(b.confidence)) < 0.3
    return abs(a.pos - b.pos) < 50


def test_score_range_and_types(scored):
    assert scored
    for r in scored:
        assert 0.0 <= r.sx_score <= 1.0
        types = [f.type for f in r.findings]
        assert len(types) == len(set(types))
        assert len(r.findings) <= len(r.raw_findings)


def test_no_kept_pair_overlaps_in_group(scored):
    for r in scored:
        ks = r.findings
        for i in range(len(ks)):
            for j in range(i + 1, len(ks)):
                if ks[i].grp == ks[j].grp:
                    assert not overlaps(ks[i], ks[j])


def test_kept_sorted_by_position(scored):
    for r in scored:
        pos = [f.pos for f in r.findings]
        assert pos == sorted(pos)


def test_dedup_is_idempotent(spark):
    from leakscan.operators.analyze import scan_and_score
    from leakscan.operators.findings import dedup_fold, rank_findings
    df = scan_and_score(FX.msgs(spark, SF_SMALL))
    et = df.schema["findings"].dataType.simpleString()
    again = df.select(F.col("findings"), dedup_fold(rank_findings(F.col("findings")), et).alias("again"))
    for r in again.collect():
        assert sorted(map(tuple, r.findings)) == sorted(map(tuple, r.again))


def test_alerts_need_six_findings_without_model(spark):
    a = REGISTRY["analyze_messages"](spark, SF_SMALL).where("alert AND model_score = 0").collect()
    assert all(r.n_kept >= 6 for r in a)


def test_empty_registry_gives_no_filtered_alerts(spark):
    from leakscan.sources.alert_store import recent_alerts_by_source
    alerts = FX.alerts_table(spark, SF_SMALL)
    empty = FX.sources(spark, SF_SMALL).limit(0)
    assert recent_alerts_by_source(alerts, empty).count() == 0
