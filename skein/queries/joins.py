"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.pairs import pairs_within
from skein.plans.registry import query
from skein.plans.scratch import scratch_path
from skein.sources.sync import Cursor
from skein.sources.tables import table
from skein.sources.views import ED, EP, RA, causal_edges, episodes, ratings

r6 = lambda c: F.round(c, 6)
HOUR = "86400000000"


@query("join_links", "select p_partkey, s_name from part left join supplier on p_partkey = s_suppkey")
def _(spark, d):
    return table(spark, d, "part").join(table(spark, d, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left").select("p_partkey", "s_name")


@query("join_tag_map", "select l_orderkey, l_linenumber::bigint as line, s_name from lineitem join supplier on l_suppkey = s_suppkey where l_discount > 0.08")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0.08").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("l_orderkey", "cast(l_linenumber as bigint) as line", "s_name")


@query("join_rating_vec", f"with {RA} select user_id, count(*) as n from ra where item_id in (select vec_id from embeddings) group by 1")
def _(spark, d):
    return ratings(spark, d).join(table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id"), "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("join_episode_embed", f"with {EP} select id, label::bigint as label from ep join embeddings on vec_id = id")
def _(spark, d):
    return episodes(spark, d).join(table(spark, d, "embeddings"), F.col("id") == F.col("vec_id")).select("id", F.col("label").cast("long").alias("label"))


@query("join_causal_edges", f"with {ED} select id, round(coalesce(avg(uplift), 0), 6) as uplift from ep left join (select * from ed where confidence >= 0.6) on id = from_id group by 1")
def _(spark, d):
    e = causal_edges(spark, d).where("confidence >= 0.6")
    return episodes(spark, d).join(e, F.col("id") == F.col("from_id"), "left").groupBy("id").agg(r6(F.coalesce(F.avg("uplift"), F.lit(0.0))).alias("uplift"))


@query("join_self_session_range", f"with {EP} select a.id as a, b.id as b from ep a join ep b on a.session_id = b.session_id and epoch_us(b.ts) - epoch_us(a.ts) > 0 and epoch_us(b.ts) - epoch_us(a.ts) < {HOUR}")
def _(spark, d):
    """Range self-join on binned time: equal session and bin, so no session is met whole."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = episodes(spark, d).select("session_id", "id", us.alias("us"), F.floor(us / int(HOUR)).alias("bin"))
    a = e.select("session_id", F.col("id").alias("a"), F.col("us").alias("ua"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = e.select("session_id", F.col("id").alias("b"), F.col("us").alias("ub"), "bin")
    return a.join(b, ["session_id", "bin"]).where(f"ub - ua > 0 and ub - ua < {HOUR}").select("a", "b")


@query("join_self_later", f"with {EP} select a.id, count(*) as later from ep a join ep b on a.session_id = b.session_id and b.ts > a.ts group by 1 having count(*) > 5")
def _(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"))
    return episodes(spark, d).select("id", (F.rank().over(w) - 1).cast("long").alias("later")).where("later > 5")


@query("join_exists_prior", f"with {EP} select id from ep a where exists (select 1 from ep b where b.session_id = a.session_id and b.task = a.task and b.ts < a.ts)")
def _(spark, d):
    e = episodes(spark, d)
    first = e.groupBy("session_id", "task").agg(F.min("ts").alias("t0"))
    return e.join(first, ["session_id", "task"]).where("t0 < ts").select("id")


@query("join_in_subquery", f"with {ED} select id from ep where id in (select to_id from ed where uplift > 0.1) and id not in (select from_id from ed where uplift < -0.1)")
def _(spark, d):
    ed = causal_edges(spark, d)
    up, down = ed.where("uplift > 0.1").select(F.col("to_id").alias("id")), ed.where("uplift < -0.1").select(F.col("from_id").alias("id"))
    return episodes(spark, d).join(up, "id", "left_semi").join(down, "id", "left_anti").select("id")


@query("join_protected_delete", f"with {ED} select id from ep where reward < 0.02 and id not in (select from_id from ed where confidence > 0.9 union select to_id from ed where confidence > 0.9)")
def _(spark, d):
    ed = causal_edges(spark, d).where("confidence > 0.9")
    held = ed.select(F.col("from_id").alias("id")).union(ed.select("to_id")).distinct()
    return episodes(spark, d).where("reward < 0.02").join(held, "id", "left_anti").select("id")


@query("join_confounder", f"with {EP} select distinct id from ep where session_id in (select session_id from ep where id = 1 union select session_id from ep where id = 2)")
def _(spark, d):
    e = episodes(spark, d)
    return e.join(e.where("id in (1, 2)").select("session_id").distinct(), "session_id", "left_semi").select("id")


@query("join_shared_session", f"with {EP}, t as (select distinct session_id, task from ep) select a.task as a, b.task as b, least(count(*) / 100, 1.0) as shared from t a join t b on a.session_id = b.session_id and a.task < b.task group by all")
def _(spark, d):
    t = episodes(spark, d).select("session_id", "task").distinct()
    j = t.select("session_id", F.col("task").alias("a")).join(t.select("session_id", F.col("task").alias("b")), "session_id").where("a < b")
    return j.groupBy("a", "b").agg(F.least(F.count("*") / 100, F.lit(1.0)).alias("shared"))


@query("join_instrument", f"with {ED} select x.from_id as a, x.to_id as b, y.to_id as c from ed x join ed y on x.to_id = y.from_id where not exists (select 1 from ed z where z.from_id = x.from_id and z.to_id = y.to_id)")
def _(spark, d):
    ed = causal_edges(spark, d)
    x, y = ed.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), ed.select(F.col("from_id").alias("b"), F.col("to_id").alias("c"))
    return x.join(y, "b").join(ed.select(F.col("from_id").alias("a"), F.col("to_id").alias("c")), ["a", "c"], "left_anti").select("a", "b", "c")


@query("join_left_count", "select n_name, count(c_custkey) as n, max(c_acctbal) as top from nation left join customer on n_nationkey = c_nationkey group by 1")
def _(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("c_custkey").alias("n"), F.max("c_acctbal").alias("top"))


@query("join_graph_enrich", """select p_partkey, coalesce(suppliers, 0) as suppliers, coalesce(orders, 0) as orders from part left join (select l_partkey as a, count(distinct l_suppkey) as suppliers from lineitem group by 1) on a = p_partkey
    left join (select l_partkey as b, count(distinct l_orderkey) as orders from lineitem where l_quantity > 25 group by 1) on b = p_partkey""")
def _(spark, d):
    i = table(spark, d, "lineitem")
    a = i.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("suppliers"))
    b = i.where("l_quantity > 25").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("orders"))
    return table(spark, d, "part").join(a, "p_partkey", "left").join(b, "p_partkey", "left").select("p_partkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("join_policy", f"with {EP}, p as (select session_id, task, avg(reward) as policy from ep where success group by all) select id, round(coalesce(policy, 0.5), 6) as policy from ep left join p using (session_id, task)")
def _(spark, d):
    e = episodes(spark, d)
    p = e.where("success").groupBy("session_id", "task").agg(F.avg("reward").alias("policy"))
    return e.join(p, ["session_id", "task"], "left").select("id", r6(F.coalesce("policy", F.lit(0.5))).alias("policy"))


@query("join_collab", f"with {RA}, u as (select distinct user_id, item_id from ra) select a.item_id as a, b.item_id as b, count(*) as n from u a join u b on a.user_id = b.user_id and a.item_id < b.item_id group by all")
def _(spark, d):
    return pairs_within(ratings(spark, d), "user_id", "item_id").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("join_store_reconcile", "select coalesce(a, b) as k, case when b is null then 'missing_b' when a is null then 'missing_a' when x = y then 'match' else 'mismatch' end as state from (select c_custkey as a, c_nationkey as x from customer where c_custkey % 3 > 0) full join (select c_custkey as b, case when c_custkey % 5 = 0 then -1 else c_nationkey end as y from customer where c_custkey % 4 > 0) on a = b")
def _(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 3 > 0").selectExpr("c_custkey as a", "c_nationkey as x")
    b = c.where("c_custkey % 4 > 0").selectExpr("c_custkey as b", "case when c_custkey % 5 = 0 then -1 else c_nationkey end as y")
    state = F.when(F.col("b").isNull(), "missing_b").when(F.col("a").isNull(), "missing_a").when(F.col("x") == F.col("y"), "match").otherwise("mismatch")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("k"), state.alias("state"))


@query("join_asof", f"with {EP} select o_orderkey, id as episode from orders o left join lateral (select id from ep where session_id = o_custkey % 150 and ts <= o_orderdate + interval 9000 day order by ts desc, id desc limit 1) on true")
def _(spark, d):
    """As-of join by merging both sides into one ordered run per key."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("k"), (F.col("o_orderdate") + F.expr("interval 9000 days")).alias("t"), F.col("o_orderkey").alias("o"), F.lit(None).cast("long").alias("id"))
    e = episodes(spark, d).select(F.col("session_id").alias("k"), F.col("ts").alias("t"), F.lit(None).cast("long").alias("o"), "id")
    w = Window.partitionBy("k").orderBy("t", F.col("o").asc_nulls_first(), F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("episode", F.last("id", ignorenulls=True).over(w)).where("o is not null").select(F.col("o").alias("o_orderkey"), "episode")


@query("sink_upsert", "select k, arg_max(v, (t, v)) as v from (select c_custkey as k, c_acctbal as v, 0 as t from customer union all select c_custkey, c_acctbal * 2, 1 from customer where c_custkey % 2 = 0) group by 1")
def _(spark, d):
    c = table(spark, d, "customer")
    both = c.selectExpr("c_custkey as k", "c_acctbal as v", "0 as t").union(c.where("c_custkey % 2 = 0").selectExpr("c_custkey", "c_acctbal * 2", "1"))
    return both.groupBy("k").agg(F.max_by("v", F.struct("t", "v")).alias("v"))


@query("sink_update_delete", "select c_custkey, case when c_mktsegment = 'HOUSEHOLD' then 0 else c_acctbal end as balance from customer where c_acctbal >= 0")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", 0.0).otherwise(F.col("c_acctbal")).alias("balance"))


@query("src_sync", "select event_id from events where ts > timestamp '2024-01-10' order by ts desc, event_id desc limit 100")
def _(spark, d):
    """The newest hundred rows after the stored mark of an earlier pull."""
    e, cursor = table(spark, d, "events"), Cursor(spark, scratch_path(spark, "cursor"))
    cursor.pull(e.where("ts <= timestamp_ntz '2024-01-10'"), "ts", "event_id")
    return cursor.pull(e, "ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")
