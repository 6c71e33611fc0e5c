"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import EP, RA, episodes, ratings

r6 = lambda c: F.round(c, 6)
SQL_S = "over (partition by session_id order by ts, id"


def S():
    return Window.partitionBy("session_id").orderBy("ts", "id")


@query("win_prune_rank", f"with {EP} select id from (select id, row_number() over (partition by task order by reward desc, id) as rn from ep) where rn > 50")
def _(spark, d):
    w = Window.partitionBy("task").orderBy(F.desc("reward"), "id")
    return episodes(spark, d).select("id", F.row_number().over(w).alias("rn")).where("rn > 50").select("id")


@query("win_history_frame", f"with {EP} select id, coalesce(array_to_string(list(latency) {SQL_S} rows between 5 preceding and 1 preceding), ','), '') as state, array_to_string(list(latency) {SQL_S} rows between 4 preceding and current row), ',') as next from ep")
def _(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return episodes(spark, d).select("id", text(F.collect_list("latency").over(S().rowsBetween(-5, -1))).alias("state"), text(F.collect_list("latency").over(S().rowsBetween(-4, 0))).alias("next"))


@query("win_lead_gap", f"with {EP} select id, coalesce(epoch_us(lead(ts) {SQL_S})) - epoch_us(ts) > 86400000000, true) as terminal from ep")
def _(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return episodes(spark, d).select("id", F.coalesce(us(F.lead("ts").over(S())) - us(F.col("ts")) > 86400000000, F.lit(True)).alias("terminal"))


@query("win_step", f"with {EP} select id, row_number() {SQL_S}) - 1 as step from ep")
def _(spark, d):
    return episodes(spark, d).select("id", (F.row_number().over(S()) - 1).cast("long").alias("step"))


@query("win_cap_per_user", f"with {EP} select id from (select id, row_number() {SQL_S}) as rn from ep) where rn <= 10")
def _(spark, d):
    return episodes(spark, d).select("id", F.row_number().over(S()).alias("rn")).where("rn <= 10").select("id")


@query("win_latest_version", f"with {EP} select session_id, task, arg_max(reward, (ts, id)) as reward from ep group by all")
def _(spark, d):
    return episodes(spark, d).groupBy("session_id", "task").agg(F.max_by("reward", F.struct("ts", "id")).alias("reward"))


@query("win_version_delta", f"with {EP} select id, round(abs(reward - lag(reward) over (partition by session_id, task order by ts, id)), 6) as delta from ep")
def _(spark, d):
    w = Window.partitionBy("session_id", "task").orderBy("ts", "id")
    return episodes(spark, d).select("id", r6(F.abs(F.col("reward") - F.lag("reward").over(w))).alias("delta"))


@query("win_policy_improve", f"with {EP} select session_id, round(avg(l - f), 6) as gain from (select session_id, task, arg_min(reward, (ts, id)) as f, arg_max(reward, (ts, id)) as l from ep group by all) group by 1")
def _(spark, d):
    g = episodes(spark, d).groupBy("session_id", "task").agg(F.min_by("reward", F.struct("ts", "id")).alias("f"), F.max_by("reward", F.struct("ts", "id")).alias("l"))
    return g.groupBy("session_id").agg(r6(F.avg(F.col("l") - F.col("f"))).alias("gain"))


@query("win_running_mean", f"with {EP} select id, round(avg(reward) {SQL_S} rows unbounded preceding), 12) as mean from ep")
def _(spark, d):
    return episodes(spark, d).select("id", F.round(F.avg("reward").over(S().rowsBetween(Window.unboundedPreceding, 0)), 12).alias("mean"))


@query("win_gini", f"with {EP}, r as (select session_id, reward, row_number() over (partition by session_id order by reward, id) as i, count(*) over (partition by session_id) as n from ep) select session_id, round(sum((2 * i - n - 1) * reward) / (any_value(n) * sum(reward)), 6) as gini from r group by 1")
def _(spark, d):
    w = Window.partitionBy("session_id")
    r = episodes(spark, d).select("session_id", "reward", F.row_number().over(w.orderBy("reward", "id")).alias("i"), F.count("*").over(w).alias("n"))
    return r.groupBy("session_id").agg(r6(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("reward")) / (F.max("n") * F.sum("reward"))).alias("gini"))


@query("win_regression_detect", f"""with {EP}, r as (select session_id, reward, row_number() {SQL_S}) as i, count(*) over (partition by session_id) as n from ep),
    g as (select session_id, avg(reward) filter (i <= 5) as base, avg(reward) filter (i > n - 2) as recent from r group by 1 having count(*) >= 7)
    select session_id, round((base - recent) / base, 6) as fall, case when (base - recent) / base > 0.3 then 'severe' when (base - recent) / base > 0.15 then 'moderate' when (base - recent) / base > 0.1 then 'mild' else 'none' end as severity from g""")
def _(spark, d):
    r = episodes(spark, d).select("session_id", "reward", F.row_number().over(S()).alias("i"), F.count("*").over(Window.partitionBy("session_id")).alias("n"))
    g = r.groupBy("session_id").agg(F.avg(F.when(F.col("i") <= 5, F.col("reward"))).alias("b"), F.avg(F.when(F.col("i") > F.col("n") - 2, F.col("reward"))).alias("r"), F.count("*").alias("c")).where("c >= 7")
    fall = (F.col("b") - F.col("r")) / F.col("b")
    return g.select("session_id", r6(fall).alias("fall"), F.when(fall > 0.3, "severe").when(fall > 0.15, "moderate").when(fall > 0.1, "mild").otherwise("none").alias("severity"))


@query("sup_volatility", f"with {EP} select id, round(case when count(*) {SQL_S} rows 9 preceding) = 10 then stddev_pop(value) {SQL_S} rows 9 preceding) end, 6) as vol from ep")
def _(spark, d):
    w = S().rowsBetween(-9, 0)
    return episodes(spark, d).select("id", r6(F.when(F.count("*").over(w) == 10, F.stddev_pop("value").over(w))).alias("vol"))


@query("sup_flash_crash", f"with {EP} select id, coalesce(value < 0.9 * lag(value, 9) {SQL_S}), false) as crash from ep")
def _(spark, d):
    return episodes(spark, d).select("id", F.coalesce(F.col("value") < 0.9 * F.lag("value", 9).over(S()), F.lit(False)).alias("crash"))


@query("sup_signal_rules", f"with {EP} select id, case when value > lag(value) {SQL_S}) and lag(value) {SQL_S}) > lag(value, 2) {SQL_S}) then 'buy' when value < lag(value) {SQL_S}) and lag(value) {SQL_S}) < lag(value, 2) {SQL_S}) then 'sell' else 'hold' end as signal from ep")
def _(spark, d):
    a, b = F.lag("value").over(S()), F.lag("value", 2).over(S())
    v = F.col("value")
    return episodes(spark, d).select("id", F.when((v > a) & (a > b), "buy").when((v < a) & (a < b), "sell").otherwise("hold").alias("signal"))


@query("sup_history_cap", f"with {EP} select id from (select id, row_number() over (partition by session_id order by ts desc, id desc) as rn from ep) where rn <= 100")
def _(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return episodes(spark, d).select("id", F.row_number().over(w).alias("rn")).where("rn <= 100").select("id")


@query("sup_recency_vector", f"with {RA}, w as (select user_id, item_id, row_number() over (partition by user_id order by ts, order_id, line) as i, count(*) over (partition by user_id) as n from ra) select user_id, round(sum(power(i / n, 2)), 6) as weight, max(n) as n from w group by 1")
def _(spark, d):
    u = Window.partitionBy("user_id")
    w = ratings(spark, d).select("user_id", F.row_number().over(u.orderBy("ts", "order_id", "line")).alias("i"), F.count("*").over(u).alias("n"))
    return w.groupBy("user_id").agg(r6(F.sum(F.pow(F.col("i") / F.col("n"), F.lit(2)))).alias("weight"), F.max("n").alias("n"))


@query("sort_worst_n", f"with {EP} select id from ep order by reward, ts, id limit 25")
def _(spark, d):
    return episodes(spark, d).orderBy("reward", "ts", "id").limit(25).select("id")


@query("sup_page", "select p_partkey, (select ceil(count(*) / 20)::bigint from part) as pages from part order by p_retailprice desc, p_partkey limit 20 offset 40")
def _(spark, d):
    p = table(spark, d, "part")
    pages = -(-p.count() // 20)
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", F.lit(pages).cast("long").alias("pages"))


@query("st_episode_session", f"""with {EP}, g as (select *, case when ts - lag(ts) {SQL_S}) < interval 1 day then 0 else 1 end as fresh from ep), s as (select *, sum(fresh) {SQL_S} rows unbounded preceding) as k from g)
    select session_id, min(ts) as start, count(*) as n from s group by session_id, k""")
def _(spark, d):
    g = episodes(spark, d).groupBy("session_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return g.select("session_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("st_rollup_hourly", "select date_trunc('hour', ts) as start, count(*) as n, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), r6(F.expr("percentile(value, 0.95)")).alias("p95"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "p95")


@query("st_rate_window", "select user_id, time_bucket(interval 1 day, ts) as start, count(*) as n from events group by all having count(*) > 3")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).where("n > 3")
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("st_ttl", "select event_id from events where ts + interval 5 day > (select max(ts) from events)")
def _(spark, d):
    e = table(spark, d, "events")
    asof = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return e.where(F.col("ts") + F.expr("interval 5 days") > asof).select("event_id")


@query("st_conflict", "select user_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
