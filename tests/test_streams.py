"""Streams whose rows outgrow the driver."""

import uuid

from skein import queries as core
from skein.plans.scratch import scratch_path
from skein.streaming import events as S


def test_appended_rows_do_not_stay_in_the_driver(spark):
    found = core.QUERIES["st_dedupe"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MemoryPlan" not in plan and "parquet" in plan
    assert found.count() == found.distinct().count() > 0


def test_stream_of_no_files(spark, tmp_path):
    found = S.drain(S.unique(S.read_events(spark, str(tmp_path))), "none_" + uuid.uuid4().hex, scratch_path(spark, "stream"))
    assert found.collect() == [] and "event_id" in found.columns
