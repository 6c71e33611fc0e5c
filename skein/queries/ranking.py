"""Search, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import ranking as R
from skein.operators import vectors as V
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import ED, EP, causal_edges, episodes

r6 = lambda c: F.round(c, 6)
Q0 = "q as (select embedding::double[] as q from embeddings where vec_id = 0)"
TOP = """s as (select a.vec_id as query, b.vec_id as id, b.label as label, a.label as ql, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    t as (select *, row_number() over (partition by query order by score desc, id) as rank from s)"""


def _q0(spark, d):
    e = table(spark, d, "embeddings")
    return e, F.array(*[F.lit(x) for x in V.vector_of(e, "vec_id", 0)])


def _top(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return R.knn_batch(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


for _name, _f, _sql in (
    ("vec_cosine", V.cosine, "list_cosine_similarity(embedding::double[], q)"),
    ("vec_dot", V.dot, "list_dot_product(embedding::double[], q)"),
    ("vec_l2", V.l2, "list_distance(embedding::double[], q)"),
    ("vec_l1", V.l1, "list_sum(list_transform(list_zip(embedding::double[], q), lambda z: abs(z[1] - z[2])))"),
):
    query(_name, f"with {Q0} select vec_id, round({_sql}, 6) as v from embeddings, q")(lambda spark, d, f=_f: (lambda e, q: e.select("vec_id", r6(f("embedding", q)).alias("v")))(*_q0(spark, d)))


@query("vec_sim_from_dist", f"with {Q0} select vec_id, round(1 / (1 + list_distance(embedding::double[], q)), 6) as sim, round(exp(-list_distance(embedding::double[], q)), 6) as e from embeddings, q")
def _(spark, d):
    e, q = _q0(spark, d)
    return e.select("vec_id", r6(1 / (1 + V.l2("embedding", q))).alias("sim"), r6(F.exp(-V.l2("embedding", q))).alias("e"))


@query("vec_normalize", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x)) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as s from embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    n = V.norm("embedding")
    return e.select("vec_id", n.alias("n"), F.col("embedding").cast("array<double>").alias("v")).select("vec_id", r6(F.aggregate(F.transform("v", lambda x: x / F.col("n")), F.lit(0.0), lambda s, x: s + x)).alias("s"))


@query("knn_batch", f"with {TOP} select query, id, rank, round(score, 6) as score from t where rank <= 10")
def _(spark, d):
    return _top(spark, d).select("query", "id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query("knn_filtered", f"with {Q0} select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where label = 3 and vec_id <> 0 and list_cosine_similarity(embedding::double[], q) >= 0 order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return V.knn(e.where("label = 3"), V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 5, exclude=0, threshold=0.0).withColumn("score", r6("score"))


@query("knn_hybrid_query", """with h as (select list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: 0.7 * z[1] + 0.3 * z[2]) as q from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id = 1)
    select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, h order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 10""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    a, b = V.vector_of(e, "vec_id", 0), V.vector_of(e, "vec_id", 1)
    return V.knn(e, [0.7 * x + 0.3 * y for x, y in zip(a, b)], "vec_id", "embedding", 10).withColumn("score", r6("score"))


@query("topk_overfetch", f"with {Q0}, t as (select vec_id, label, list_cosine_similarity(embedding::double[], q) as s from embeddings, q where vec_id <> 0 order by s desc, vec_id limit 30) select vec_id from t where label < 5 order by s desc, vec_id limit 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    top = V.knn(e, V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 30, exclude=0, keep=("label",))
    return top.where("label < 5").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id")


@query("eval_ir", f"""with {TOP}, k as (select *, (label = ql)::int as rel, (select count(*) from embeddings e where e.label = ql) - 1 as total from t where rank <= 10),
    g as (select query, sum(rel) / 10 as p, coalesce(1.0 / min(case when rel > 0 then rank end), 0) as mrr, sum(rel / log2(rank + 1)) as dcg, least(max(total), 10) as n from k group by 1)
    select query, round(p, 6) as precision, round(mrr, 6) as mrr, round(case when n > 0 then dcg / (select sum(1 / log2(i + 1)) from range(1, 11) r(i) where i <= n) else 0 end, 6) as ndcg from g""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    a, b = e.selectExpr("vec_id as query", "label as ql"), e.selectExpr("vec_id as id", "label")
    ranked = _top(spark, d).join(a, "query").join(b, "id").join(n.withColumnRenamed("label", "ql"), "ql").withColumn("relevant", F.col("ql") == F.col("label"))
    return R.evaluate(ranked, 10).select("query", r6("precision").alias("precision"), r6("mrr").alias("mrr"), r6("ndcg").alias("ndcg"))


@query("rank_mmr")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return R.mmr(_top(spark, d, 30).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("query", "id", "score", "v"), 5)


@query("rank_diversity_score", f"with {TOP}, k as (select * from t where rank <= 5) select x.query, round(avg(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as diversity from k x join k y on x.query = y.query and x.id < y.id join embeddings a on a.vec_id = x.id join embeddings b on b.vec_id = y.id group by 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    k = _top(spark, d, 5).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("query", "id", "v")
    j = k.join(k.select("query", F.col("id").alias("b"), F.col("v").alias("w")), "query").where("id < b")
    return j.groupBy("query").agg(r6(F.avg(1 - V.cosine("v", "w"))).alias("diversity"))


@query("rank_utility", f"with {ED}, u as (select from_id, avg(uplift) as uplift from ed group by 1) select id, round(0.7 * reward + 0.2 * coalesce(uplift, 0) - 0.1 * least(latency / 1000, 1.0), 6) as utility from ep left join u on id = from_id order by 0.7 * reward + 0.2 * coalesce(uplift, 0) - 0.1 * least(latency / 1000, 1.0) desc, id limit 20")
def _(spark, d):
    u = causal_edges(spark, d).groupBy("from_id").agg(F.avg("uplift").alias("uplift"))
    utility = 0.7 * F.col("reward") + 0.2 * F.coalesce("uplift", F.lit(0.0)) - 0.1 * F.least(F.col("latency") / 1000, F.lit(1.0))
    return episodes(spark, d).join(u, F.col("id") == F.col("from_id"), "left").select("id", utility.alias("u")).orderBy(F.desc("u"), "id").limit(20).select("id", r6("u").alias("utility"))


@query("rank_skill", f"with {EP} select task, round(0.4 * max(reward) + 0.3 * avg(success::int) + 0.1 * least(count(*) / 1000, 1.0) + 0.2 * avg(reward), 6) as score from ep group by 1")
def _(spark, d):
    s = 0.4 * F.max("reward") + 0.3 * F.avg(F.col("success").cast("int")) + 0.1 * F.least(F.count("*") / 1000, F.lit(1.0)) + 0.2 * F.avg("reward")
    return episodes(spark, d).groupBy("task").agg(r6(s).alias("score"))


@query("rank_policy", f"with {Q0} select vec_id, round(0.7 * list_cosine_similarity(embedding::double[], q) + 0.3 * (0.4 * (label % 3) / 3 + 0.3 * (vec_id % 7) / 7 + 0.3 * 0.5), 6) as score from embeddings, q")
def _(spark, d):
    e, q = _q0(spark, d)
    policy = 0.4 * (F.col("label") % 3) / 3 + 0.3 * (F.col("vec_id") % 7) / 7 + 0.3 * 0.5
    return e.select("vec_id", r6(0.7 * V.cosine("embedding", q) + 0.3 * policy).alias("score"))


@query("rank_merge", "select p_partkey, round(list_reduce([1.0] || list_transform(string_split(p_name, ' '), lambda g: 1 + case g when 'red' then 0.3 when 'ring' then 0.2 else 0 end::double), lambda a, b: a * b), 6) as score from part")
def _(spark, d):
    boost = F.create_map(F.lit("red"), F.lit(0.3), F.lit("ring"), F.lit(0.2))
    score = F.aggregate(F.split("p_name", " "), F.lit(1.0), lambda s, g: s * (1 + F.coalesce(F.try_element_at(boost, g), F.lit(0.0))))
    return table(spark, d, "part").select("p_partkey", r6(score).alias("score"))


@query("rank_merge_sources", "select coalesce(a, b) as id, round(least(1, coalesce(s, 0) + 0.5 * coalesce(v, 0)), 6) as score from (select p_partkey as a, p_size / 60.0 as s from part where p_partkey % 2 = 0) full join (select p_partkey as b, p_retailprice / 2000 as v from part where p_partkey % 3 = 0) on a = b")
def _(spark, d):
    p = table(spark, d, "part")
    a, b = p.where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "p_size / 60 as s"), p.where("p_partkey % 3 = 0").selectExpr("p_partkey as id", "p_retailprice / 2000 as v")
    return a.join(b, "id", "full_outer").select("id", r6(F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) + 0.5 * F.coalesce("v", F.lit(0.0)))).alias("score"))


@query("rec_action_scores", f"with {EP}, a as (select session_id, task, avg(reward) as q from ep group by all) select session_id, arg_max(task, (q, task)) as action from a group by 1")
def _(spark, d):
    a = episodes(spark, d).groupBy("session_id", "task").agg(F.avg("reward").alias("q"))
    return a.groupBy("session_id").agg(F.max_by("task", F.struct("q", "task")).alias("action"))


@query("sup_discover", "select p_partkey from part where p_type = 'ECONOMY' and p_size >= 10 order by p_retailprice desc, p_partkey limit 20")
def _(spark, d):
    return table(spark, d, "part").where("p_type = 'ECONOMY' and p_size >= 10").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey")
