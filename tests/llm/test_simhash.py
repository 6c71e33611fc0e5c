"""Plans of the fingerprint links."""

from skein.llm import simhash


def test_key_rows_never_pass_through_the_driver(spark):
    """A side of the key join has some 80 rows for each fingerprint, which its size estimate does not know."""
    fps = spark.range(2000).selectExpr("xxhash64(id) as fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    near = spark.createDataFrame([(0,), (7,), (1 << 40,), (255,)], "fp long")
    assert {tuple(r) for r in simhash.links(near).collect()} == {(0, 7), (0, 1 << 40)}
