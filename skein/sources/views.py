"""Domain views over the test tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import table


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Agent episodes from events: a session per user, reward scaled to 0..1."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("task"), "value",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("reward"), F.col("event_type").isin("purchase", "signup").alias("success"),
        F.get_json_object("props", "$.k").cast("long").alias("latency"),
    )


EP = """ep as (select event_id as id, ts, user_id as session_id, event_type as task, value, least(value / 500, 1.0) as reward,
    event_type in ('purchase', 'signup') as success, cast(json_extract_string(props, '$.k') as bigint) as latency from events)"""


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings 1..5 of parts by customers, from quantities."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + 4 * (F.col("l_quantity") - 1) / 49).alias("rating"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")
    )


RA = """ra as (select o_custkey as user_id, l_partkey as item_id, 1 + 4 * (l_quantity - 1) / 49 as rating, o_orderdate as ts, l_orderkey as order_id, l_linenumber as line
    from lineitem join orders on l_orderkey = o_orderkey)"""


def causal_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge from each episode to the next of its session."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    e = episodes(spark, d).select("*", F.lead("id").over(w).alias("to_id"), F.lead("reward").over(w).alias("r2"), F.lead("ts").over(w).alias("t2"))
    gap = F.unix_micros(F.col("t2").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.where("to_id is not null").select(F.col("id").alias("from_id"), "to_id", (F.col("r2") - F.col("reward")).alias("uplift"), (1 / (1 + gap / 3.6e9 / 24)).alias("confidence"), "session_id")


ED = (
    EP
    + """, ed as (select id as from_id, to_id, r2 - reward as uplift, 1 / (1 + (epoch_us(t2) - epoch_us(ts)) / 3.6e9 / 24) as confidence, session_id
    from (select *, lead(id) over w as to_id, lead(reward) over w as r2, lead(ts) over w as t2 from ep window w as (partition by session_id order by ts, id)) where to_id is not null)"""
)


def links(spark: SparkSession, d: str) -> DataFrame:
    """A sparse directed graph over all part keys: each part to one or two others of its block of 97."""
    p = table(spark, d, "part").selectExpr("p_partkey as src", "p_partkey - p_partkey % 97 as base", "p_size as size")
    near = p.selectExpr("src", "base + (src * 7 + 3) % 97 as dst", "size / 10 as weight")
    far = p.where("src % 3 = 0").selectExpr("src", "base + (src * 5 + 11) % 97 as dst", "size / 5 as weight")
    return near.unionByName(far).where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


LK = """lk as (select src, dst, min(weight) as weight from (
    select p_partkey as src, p_partkey - p_partkey % 97 + (p_partkey * 7 + 3) % 97 as dst, p_size / 10.0 as weight from part
    union all select p_partkey, p_partkey - p_partkey % 97 + (p_partkey * 5 + 11) % 97, p_size / 5.0 from part where p_partkey % 3 = 0) where src <> dst group by all)"""
