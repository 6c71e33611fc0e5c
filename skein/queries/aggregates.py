"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import aggregates as A
from skein.operators.vectors import dims_of, norm
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import ED, EP, RA, causal_edges, episodes, ratings

r6 = lambda c: F.round(c, 6)


def ok():
    return F.col("success").cast("int")


@query("agg_task_stats", f"with {EP} select task, count(*) as n, round(avg(success::int), 6) as success_rate, round(avg(reward), 6) as reward, round(avg(latency), 6) as latency from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy("task").agg(F.count("*").alias("n"), r6(F.avg(ok())).alias("success_rate"), r6(F.avg("reward")).alias("reward"), r6(F.avg("latency")).alias("latency"))


@query("agg_trend_7d", f"""with {EP}, t as (select task, avg(case when ts > (select max(ts) from ep) - interval 7 day then reward end) as recent, avg(case when ts <= (select max(ts) from ep) - interval 7 day then reward end) as older from ep group by 1)
    select task, round(case when coalesce(recent, 0) = 0 or coalesce(older, 0) = 0 then 0 else (recent - older) / older end, 6) as trend from t""")
def _(spark, d):
    e = episodes(spark, d)
    cut = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz") - F.expr("interval 7 days")
    t = e.groupBy("task").agg(F.avg(F.when(F.col("ts") > cut, F.col("reward"))).alias("a"), F.avg(F.when(F.col("ts") <= cut, F.col("reward"))).alias("b"))
    flat = (F.coalesce("a", F.lit(0.0)) == 0) | (F.coalesce("b", F.lit(0.0)) == 0)
    return t.select("task", r6(F.when(flat, 0.0).otherwise(F.try_divide(F.col("a") - F.col("b"), F.col("b")))).alias("trend"))


@query("agg_consolidate", f"""with {EP} select session_id, task, count(*) as n, round(avg(reward), 9) as reward, max(id) as last_id, string_agg(id::varchar, ',' order by id) as ids from ep
    where reward >= 0.05 group by all having count(*) >= 3""")
def _(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return episodes(spark, d).where("reward >= 0.05").groupBy("session_id", "task").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 9).alias("reward"), F.max("id").alias("last_id"), ids.alias("ids")).where("n >= 3")


@query("agg_pattern_stats", f"with {EP} select count(*) as n, round(avg(reward), 6) as reward, count(*) filter (ts > (select max(ts) from ep) - interval 7 day) as recent, count(*) filter (reward >= 0.8) as strong from ep")
def _(spark, d):
    e = episodes(spark, d)
    cut = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz") - F.expr("interval 7 days")
    return e.agg(F.count("*").alias("n"), r6(F.avg("reward")).alias("reward"), F.count_if(F.col("ts") > cut).alias("recent"), F.count_if(F.col("reward") >= 0.8).alias("strong"))


@query("agg_learning_group", f"with {EP} select session_id, count(*) as n, round(min(reward), 6) as low, round(max(reward), 6) as high from ep group by 1 order by n desc, session_id limit 20")
def _(spark, d):
    return episodes(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), r6(F.min("reward")).alias("low"), r6(F.max("reward")).alias("high")).orderBy(F.desc("n"), "session_id").limit(20)


@query("agg_daily_trend", f"with {EP} select ts::date as day, count(*) as n, round(avg(reward), 6) as reward from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), r6(F.avg("reward")).alias("reward"))


@query("agg_propensity", f"with {EP} select session_id, task, round(greatest(0.01, least(0.99, n / sum(n) over (partition by session_id))), 6) as propensity from (select session_id, task, count(*) as n from ep group by all)")
def _(spark, d):
    from pyspark.sql.window import Window

    g = episodes(spark, d).groupBy("session_id", "task").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("session_id"))
    return g.select("session_id", "task", r6(F.greatest(F.lit(0.01), F.least(F.lit(0.99), share))).alias("propensity"))


@query("agg_edge_stats", f"with {ED} select count(*) as n, round(avg(abs(uplift)), 6) as uplift, round(avg(confidence), 6) as confidence from ed")
def _(spark, d):
    return causal_edges(spark, d).agg(F.count("*").alias("n"), r6(F.avg(F.abs("uplift"))).alias("uplift"), r6(F.avg("confidence")).alias("confidence"))


@query("agg_uplift_ttest", f"""with {EP}, g as (select task, avg(reward) filter (latency > 50) as m1, var_pop(reward) filter (latency > 50) as v1, count(*) filter (latency > 50) as n1,
    avg(reward) filter (latency <= 50) as m0, var_pop(reward) filter (latency <= 50) as v0, count(*) filter (latency <= 50) as n0 from ep group by 1), t as (select task, m1 - m0 as u, sqrt(v1 / n1 + v0 / n0) as se from g where n1 > 0 and n0 > 0)
    select task, round(u, 6) as uplift, round(se, 6) as se, round(u / se, 5) as t_approx, round(2 * (1 - abs(u / se) / sqrt(1 + power(u / se, 2)) / 2 - 0.5), 5) as p_approx, round(u - 1.96 * se, 6) as low, round(u + 1.96 * se, 6) as high from t""")
def _(spark, d):
    u = A.uplift(episodes(spark, d).withColumn("slow", F.col("latency") > 50), "slow", "reward", "task")
    return u.select("task", r6("uplift").alias("uplift"), r6("se").alias("se"), F.round("t_approx", 5).alias("t_approx"), F.round("p_approx", 5).alias("p_approx"), r6("low").alias("low"), r6("high").alias("high"))


@query("agg_causal_gain", f"with {ED} select round(avg(case when to_id is not null then reward end) - avg(case when to_id is null then reward end), 6) as gain from ep left join (select distinct to_id from ed where uplift > 0) on id = to_id")
def _(spark, d):
    hit = causal_edges(spark, d).where("uplift > 0").select("to_id").distinct()
    j = episodes(spark, d).join(hit, F.col("id") == F.col("to_id"), "left")
    return j.agg(r6(F.avg(F.when(F.col("to_id").isNotNull(), F.col("reward"))) - F.avg(F.when(F.col("to_id").isNull(), F.col("reward")))).alias("gain"))


@query("agg_weighted_vector", f"""with {RA}, w as (select user_id, item_id, sum((rating - 1) / 4) as w from ra group by all), x as (select user_id, w, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from w join embeddings on vec_id = item_id % (select count(*) from embeddings)),
    m as (select user_id, pos, sum(w * x) / sum(w) as x from x group by all) select user_id, round(sqrt(sum(x * x)), 6) as norm, round(sum(x * pos) / sqrt(sum(x * x)), 5) as moment from m group by 1""")
def _(spark, d):
    w = ratings(spark, d).groupBy("user_id", "item_id").agg(F.sum((F.col("rating") - 1) / 4).alias("w"))
    e = table(spark, d, "embeddings")
    v = A.mean_vector(w.join(e, F.col("item_id") % e.count() == F.col("vec_id")), "user_id", "embedding", F.col("w"), dims_of(e)).withColumn("n", norm("vector"))
    moment = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("user_id", r6("n").alias("norm"), F.round(moment / F.col("n"), 5).alias("moment"))


@query("agg_genre_centroid", """with x as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings), m as (select label, pos, avg(x) as x from x group by all)
    select label::bigint as label, round(sqrt(sum(x * x)), 6) as norm from m group by 1""")
def _(spark, d):
    v = A.mean_vector(table(spark, d, "embeddings"), "label", "embedding")
    return v.select(F.col("label").cast("long").alias("label"), r6(norm("vector")).alias("norm"))


@query("agg_genome_map", "select l_suppkey as item, string_agg(l_partkey::varchar || '=' || s::varchar, ',' order by l_partkey) as tags from (select l_suppkey, l_partkey, max(l_quantity)::bigint as s from lineitem group by all) group by 1")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").cast("long").alias("s"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "s"))), lambda e: F.concat_ws("=", e["l_partkey"].cast("string"), e["s"].cast("string")))
    return m.groupBy(F.col("l_suppkey").alias("item")).agg(F.array_join(parts, ",").alias("tags"))


@query("agg_dataset_stats", "select count(*) as n, count(distinct user_id) as users, min(ts) as first, max(ts) as last from events")
def _(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("agg_distribution", "select c_mktsegment as v, count(*) as n from customer group by 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("n"))


@query("agg_norm_minmax", f"with {EP} select id, round((reward - min(reward) over ()) / (max(reward) over () - min(reward) over ()), 6) as scaled from ep")
def _(spark, d):
    return A.minmax(episodes(spark, d), "reward", "scaled").select("id", r6("scaled").alias("scaled"))


@query("agg_norm_feature", f"with {EP} select id, round((reward - avg(reward) over ()) / stddev_pop(reward) over (), 5) as z from ep")
def _(spark, d):
    return A.zscore(episodes(spark, d), "reward", "z").select("id", F.round("z", 5).alias("z"))


@query("agg_dedupe_max", "select l_partkey as id, max(l_extendedprice) as score, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) as shard from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("score"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("shard"))


@query("agg_hub_stats", "select c_mktsegment as tenant, count(distinct c_nationkey) as agents, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high from customer group by 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("tenant")).agg(F.countDistinct("c_nationkey").alias("agents"), F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("agg_task_duration", "select o_orderstatus as status, o_orderpriority as priority, count(*) as n, round(avg(epoch(l_shipdate) - epoch(o_orderdate)), 3) as seconds from orders join lineitem on l_orderkey = o_orderkey group by all")
def _(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return j.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg(gap), 3).alias("seconds"))


@query("agg_percentile", f"with {EP} select task, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy("task").agg(*[F.expr(f"percentile(value, {p})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("agg_regression", f"with {EP} select session_id, round(regr_slope(reward, epoch_us(ts) / 8.64e10), 5) + 0.0::double as slope, round(regr_r2(reward, epoch_us(ts) / 8.64e10), 5) as r2, round(median(reward), 6) as median, round(stddev_pop(reward), 6) as spread from ep group by 1")
def _(spark, d):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10
    return episodes(spark, d).groupBy("session_id").agg((F.round(F.regr_slope("reward", x), 5) + F.lit(0.0)).alias("slope"), F.round(F.regr_r2("reward", x), 5).alias("r2"), r6(F.median("reward")).alias("median"), r6(F.stddev_pop("reward")).alias("spread"))


@query("agg_pivot_metrics", f"with {EP} select session_id, count(*) filter (task = 'click') as click, count(*) filter (task = 'error') as error, count(*) filter (task = 'purchase') as purchase from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy("session_id").pivot("task", ["click", "error", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg_keyword_freq", "select w, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents where lang = 'en') where length(w) > 3 and w not in ('that', 'this', 'with') group by 1 having count(*) >= 2 order by n desc, w limit 50")
def _(spark, d):
    w = table(spark, d, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.where("length(w) > 3 and w not in ('that', 'this', 'with')").groupBy("w").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "w").limit(50)


@query("agg_phrase_patterns", "select s, count(*) as n from (select trim(unnest(string_split_regex(text, '[.!?\\n]+'))) as s from documents) where length(s) > 10 and length(s) < 100 and regexp_matches(s, 'ing') group by 1 having count(*) >= 2 order by n desc, s limit 10")
def _(spark, d):
    s = table(spark, d, "documents").select(F.explode(F.split("text", "[.!?\n]+")).alias("s")).select(F.trim("s").alias("s"))
    return s.where("length(s) > 10 and length(s) < 100 and s rlike 'ing'").groupBy("s").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "s").limit(10)


@query("agg_learning_curve", f"""with {EP}, h as (select session_id, reward, row_number() over (partition by session_id order by id) <= count(*) over (partition by session_id) // 2 as early from ep)
    select session_id, round(avg(reward) filter (early), 6) as first, round(avg(reward) filter (not early), 6) as second from h group by 1""")
def _(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("session_id")
    h = episodes(spark, d).select("session_id", "reward", (F.row_number().over(w.orderBy("id")) <= F.expr("count(*) over (partition by session_id) div 2")).alias("early"))
    return h.groupBy("session_id").agg(r6(F.avg(F.when(F.col("early"), F.col("reward")))).alias("first"), r6(F.avg(F.when(~F.col("early"), F.col("reward")))).alias("second"))


@query("agg_metadata_const", "select p_brand as g, k, any_value(v) as v from (select p_brand, 'type' as k, p_type as v from part union all select p_brand, 'half', (p_size < 51)::varchar from part) group by all having count(distinct v) = 1")
def _(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.explode(F.create_map(F.lit("type"), "p_type", F.lit("half"), (F.col("p_size") < 51).cast("string"))).alias("k", "v"))
    return m.groupBy("g", "k").agg(F.countDistinct("v").alias("n"), F.any_value("v").alias("v")).where("n = 1").select("g", "k", "v")


@query("agg_cube", "select coalesce(o_orderstatus, '*') as s, coalesce(o_orderpriority, '*') as p, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("s"), F.coalesce("o_orderpriority", F.lit("*")).alias("p"), "n")


@query("sup_completion_rate", f"with {EP} select session_id, round(sum(case when success then reward else 0 end) / count(*), 6) as rate from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy("session_id").agg(r6(F.sum(F.coalesce(F.when(F.col("success"), F.col("reward")), F.lit(0.0))) / F.count("*")).alias("rate"))


@query("sup_latency_metrics", f"""with {EP}, r as (select task, value, row_number() over (partition by task order by value) as rn, count(*) over (partition by task) as n from ep)
    select task, any_value(n) as n, round(avg(value), 6) as mean, max(value) filter (rn = least(floor(n * 0.95) + 1, n)) as p95, max(value) filter (rn = least(floor(n * 0.99) + 1, n)) as p99 from r group by 1""")
def _(spark, d):
    return A.nearest_rank(episodes(spark, d), "task", "value", {"p95": 0.95, "p99": 0.99}).withColumn("mean", r6("mean"))


@query("sup_stability", f"with {EP} select task, round(1 - least(1, stddev_pop(reward) / avg(reward)), 6) as stability from ep group by 1")
def _(spark, d):
    return episodes(spark, d).groupBy("task").agg(r6(1 - F.least(F.lit(1.0), F.stddev_pop("reward") / F.avg("reward"))).alias("stability"))


@query("sup_order_imbalance", f"with {EP} select session_id, round((count(*) filter (task = 'purchase') - count(*) filter (task = 'error')) / (count(*) filter (task = 'purchase') + count(*) filter (task = 'error') + 1), 6) as imbalance from ep group by 1")
def _(spark, d):
    b, s = F.count_if(F.col("task") == "purchase"), F.count_if(F.col("task") == "error")
    return episodes(spark, d).groupBy("session_id").agg(r6((b - s) / (b + s + 1)).alias("imbalance"))


@query("sup_db_stats", "select 'orders' as t, count(*) as n from orders union all select 'part', count(*) from part union all select 'events', count(*) from events")
def _(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in ("orders", "part", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("t", "n")
