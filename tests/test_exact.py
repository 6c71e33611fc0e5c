"""Results that must not hang on the last bits of sums."""

import duckdb
from pyspark.sql import functions as F

from skein import queries as core
from skein.functions import media as M
from skein.operators import sequential


def _events(spark, folder, rows):
    """``rows`` of (id, second, user, value), a file each in the order given."""
    for i, (event, second, user, value) in enumerate(rows):
        df = spark.createDataFrame([(event, user, "view", value)], "event_id long, user_id long, event_type string, value double")
        df = df.select("event_id", F.timestamp_seconds(F.lit(second)).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit('{"k": 1}').alias("props"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_deviation_on_the_edge_of_a_band(spark):
    """The deviation of these line numbers over 8 is 0.2 as written, so not over it."""
    lines = [n / 8 for n in (1, 1, 5, 1, 1)]  # mean 1.8, variance 2.56
    df = spark.createDataFrame([([0.5] * 5, lines), ([0.5] * 5, [0.0, 0.5, 0.0, 0.5, 0.0])], "m array<double>, f array<double>")
    rows = [[g.label for g in r.g] for r in df.select(M.motion_genres(F.col("m"), F.col("f")).alias("g")).collect()]
    assert rows == [[], ["Thriller"]]
    order = spark.createDataFrame([(list(reversed(lines)),)], "f array<double>")
    assert order.select(M.spread(F.col("f")).alias("s")).first().s == 0.2
    assert spark.createDataFrame([([],)], "f array<double>").select(M.spread(F.col("f")).alias("s")).first().s is None


def test_equal_rewards_tie_in_any_order(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit, and neither session beats the other."""
    _events(spark, tmp_path, [(1, 1, 1, 50.0), (2, 2, 1, 100.0), (3, 3, 1, 150.0)])
    rows = spark.read.parquet(f"{tmp_path}/events.parquet").unionByName(spark.read.parquet(f"{tmp_path}/events.parquet").select((10 - F.col("event_id")).alias("event_id"), "ts", F.lit(2).cast("long").alias("user_id"), "event_type", "value", "props"))
    rows.orderBy(F.when(F.col("user_id") == 1, F.col("event_id")).otherwise(F.col("event_id") * 2)).coalesce(1).write.parquet(f"{tmp_path}/both/events.parquet")
    assert sorted(r.id for r in core.QUERIES["g_pareto"](spark, f"{tmp_path}/both").collect()) == [1, 2]


def test_mean_of_an_arm_in_order(spark):
    """Whatever ranges an arm's rows lie in, its rewards are added one after another in order."""
    values = [0.1 * (7 * i % 11) + 0.013 * (i % 3) for i in range(300)]
    df = spark.createDataFrame([(k, i, v) for k in range(40) for i, v in enumerate(values[k : k + 60])], "k long, at long, r double").repartition(7)
    want = {}
    for k in range(40):
        total = 0.0
        for v in values[k : k + 60]:
            total += v
        want[k] = total / 60
    assert {r.k: r["mean"] for r in sequential.bandit(df, "k", ["at"], "r").collect()} == want


def test_policy_means_between_two_places(spark):
    """Two of these means lie right between two sixth places, where the SQL's rounding of the double decides."""
    folder, c = "/root/testdata/sf0.01", duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    want = sorted(c.execute(core.SQL["fn_update_policy"]).fetchall())
    assert sorted(tuple(r) for r in core.QUERIES["fn_update_policy"](spark, folder).collect()) == want
