"""The cluster batch job: alerts once ever across reruns."""
import uuid

from conftest import SF_SMALL
from leakscan import jobs
from leakscan.plans import fixtures as FX
from leakscan.session import scratch_path


def test_batch_job_rerun_adds_nothing(spark):
    d = scratch_path(spark, f"jobs-{uuid.uuid4().hex}")
    FX.msgs(spark, SF_SMALL).write.parquet(f"{d}/msgs")
    jobs.batch_job(spark, f"{d}/msgs", f"{d}/alerts")
    first = sorted(map(tuple, spark.read.parquet(f"{d}/alerts").select("chat_id", "message_id").collect()))
    jobs.batch_job(spark, f"{d}/msgs", f"{d}/alerts")
    again = sorted(map(tuple, spark.read.parquet(f"{d}/alerts").select("chat_id", "message_id").collect()))
    assert first and first == again
