"""Search variants, attention, vector tools and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import attention as T
from skein.operators import graph as G
from skein.operators import indexes as I
from skein.operators import ranking as R
from skein.operators import vectors as V
from skein.operators.aggregates import mean_vector
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import EP, RA, episodes, ratings

r6 = lambda c: F.round(c, 6)
DBL = "embedding::double[]"
Q0 = f"q as (select {DBL} as q from embeddings where vec_id = 0)"
PAIRS = f"""p as (select a.vec_id as query, b.vec_id as id, a.label as ql, b.label as label, list_cosine_similarity(a.{DBL}, b.{DBL}) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    t as (select *, row_number() over (partition by query order by score desc, id) as rank from p)"""


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _q0(spark, d):
    return F.array(*[F.lit(x) for x in V.vector_of(_emb(spark, d), "vec_id", 0)])


def _top(spark, d, k):
    e = _emb(spark, d)
    return R.knn_batch(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


@query("win_topk_per_query", f"with {PAIRS} select query, id, rank::bigint as rank from t where rank <= 5")
def _(spark, d):
    return _top(spark, d, 5).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("topk_argsort", f"with {Q0} select vec_id from embeddings, q where vec_id <> 0 and list_cosine_similarity({DBL}, q) >= 0.05 order by list_cosine_similarity({DBL}, q) desc, vec_id limit 20")
def _(spark, d):
    e = _emb(spark, d)
    return V.knn(e, V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 20, exclude=0, threshold=0.05).select("vec_id")


@query("topk_exclude_self", f"with {Q0} select vec_id from embeddings, q where vec_id <> 0 order by list_inner_product({DBL}, q) desc, vec_id limit 7")
def _(spark, d):
    return _emb(spark, d).where("vec_id <> 0").orderBy(F.desc(V.dot("embedding", _q0(spark, d))), "vec_id").limit(7).select("vec_id")


@query("flt_threshold", f"with {Q0} select vec_id from embeddings, q where list_cosine_similarity({DBL}, q) >= 0.1")
def _(spark, d):
    return _emb(spark, d).where(V.cosine("embedding", _q0(spark, d)) >= 0.1).select("vec_id")


@query("knn_multimodal", f"""with {Q0}, s as (select vec_id, list_cosine_similarity(({DBL})[1:32], q[1:32]) as a, list_cosine_similarity(({DBL})[33:48], q[33:48]) as b, list_cosine_similarity(({DBL})[49:64], q[49:64]) as c from embeddings, q)
    select vec_id, round((0.5 * a + 0.3 * b + 0.1 * c) / 0.9, 6) as score from s""")
def _(spark, d):
    q, e = _q0(spark, d), F.col("embedding")
    spans = ((0.5, 1, 32), (0.3, 33, 16), (0.1, 49, 16))
    score = sum((w * V.cosine(F.slice(e, at, n), F.slice(q, at, n)) for w, at, n in spans), F.lit(0.0)) / sum(w for w, _, _ in spans)
    return _emb(spark, d).select("vec_id", r6(score).alias("score"))


@query("sup_matrix_topk", f"with {PAIRS} select query, count(*) as n, round(max(score), 6) as best from p where score >= 0.2 group by 1")
def _(spark, d):
    """Pairs of the stated query set and all rows over a threshold, counted per query."""
    e = _emb(spark, d)
    near = R.similar_pairs(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 0.2)
    return near.groupBy("query").agg(F.count("*").alias("n"), r6(F.max("score")).alias("best"))


@query("sup_taste_distance", """with x as (select label, vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from embeddings), c as (select label, pos, avg(x) as m from x group by all)
    select vec_id, round(sqrt(sum((x - m) * (x - m))), 6) as distance from x join c using (label, pos) group by 1""")
def _(spark, d):
    from skein.operators.aggregates import mean_vector

    e = _emb(spark, d)
    return e.join(mean_vector(e, "label", "embedding"), "label").select("vec_id", r6(V.l2("embedding", "vector")).alias("distance"))


# ---------------------------------------------------------------- attention


SESSION = f"""s as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as i, embedding[1:4]::double[] as v from events join embeddings on vec_id = event_id % (select count(*) from embeddings)),
    k as (select a.event_id as query, a.i as qi, b.i as ki, a.v as q, b.v as k from s a join s b on a.user_id = b.user_id and b.i between a.i - 8 and a.i)"""


def _window(spark, d):
    """Each event with the vectors of itself and the 8 before it in its session."""
    e = _emb(spark, d)
    ev = table(spark, d, "events").withColumn("vec_id", F.col("event_id") % e.count()).join(e, "vec_id").select("event_id", "user_id", "ts", F.slice("embedding", 1, 4).cast("array<double>").alias("v"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    held = ev.select("event_id", "v", F.row_number().over(w).alias("i"), F.collect_list(F.struct("v")).over(w.rowsBetween(-8, 0)).alias("near"))
    return held.select(F.col("event_id").alias("query"), "i", F.col("v").alias("q"), F.posexplode("near").alias("pos", "n")).select("query", "i", "q", F.col("n.v").alias("k"), F.col("n.v").alias("x"), (F.greatest(F.col("i") - 8, F.lit(1)) + F.col("pos")).alias("ki"))


def _digest(attended):
    return attended.select("query", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("moment"))


@query("vec_attention_flash", f"""with {SESSION}, e as (select query, k, exp(list_inner_product(q, k) / 2 - max(list_inner_product(q, k) / 2) over (partition by query)) as w from k)
    select query, round(sum(w * (k[1] + 2 * k[2] + 3 * k[3] + 4 * k[4])) / sum(w), 5) as moment from e group by 1""")
def _(spark, d):
    return _digest(T.attend(_window(spark, d), 4))


@query("vec_attention_multihead", f"""with {SESSION}, e as (select query, k, exp(list_inner_product(q[1:2], k[1:2]) / sqrt(2)) as w1, exp(list_inner_product(q[3:4], k[3:4]) / sqrt(2)) as w2 from k)
    select query, round(sum(w1 * (k[1] + 2 * k[2])) / sum(w1) + sum(w2 * (3 * k[3] + 4 * k[4])) / sum(w2), 5) as moment from e group by 1""")
def _(spark, d):
    return _digest(T.attend(_window(spark, d), 4, heads=2))


@query("vec_attention_linear", f"""with {SESSION}, e as (select query, k, list_inner_product(list_transform(q, lambda x: case when x > 0 then x + 1 else exp(x) end), list_transform(k, lambda x: case when x > 0 then x + 1 else exp(x) end)) as w from k)
    select query, round(sum(w * (k[1] + 2 * k[2] + 3 * k[3] + 4 * k[4])) / sum(w), 5) as moment from e group by 1""")
def _(spark, d):
    return _digest(T.attend(_window(spark, d), 4, kernel="linear"))


@query("vec_attention_hyperbolic", f"""with {SESSION}, n as (select query, k, list_transform(q, lambda x: x / (1 + sqrt(list_inner_product(q, q)))) as a, list_transform(k, lambda x: x / (1 + sqrt(list_inner_product(k, k)))) as b from k),
    e as (select query, k, exp(-acosh(greatest(1, 1 + 2 * power(list_distance(a, b), 2) / ((1 - list_inner_product(a, a)) * (1 - list_inner_product(b, b)))))) as w from n)
    select query, round(sum(w * (k[1] + 2 * k[2] + 3 * k[3] + 4 * k[4])) / sum(w), 5) as moment from e group by 1""")
def _(spark, d):
    return _digest(T.attend(_window(spark, d), 4, kernel="hyperbolic"))


@query("vec_attention_rope", f"""with {SESSION}, r as (select query, k, [q[1] * cos(qi) - q[2] * sin(qi), q[1] * sin(qi) + q[2] * cos(qi), q[3] * cos(qi * 0.01) - q[4] * sin(qi * 0.01), q[3] * sin(qi * 0.01) + q[4] * cos(qi * 0.01)] as q,
    [k[1] * cos(ki) - k[2] * sin(ki), k[1] * sin(ki) + k[2] * cos(ki), k[3] * cos(ki * 0.01) - k[4] * sin(ki * 0.01), k[3] * sin(ki * 0.01) + k[4] * cos(ki * 0.01)] as rk from k),
    e as (select query, k, exp(list_inner_product(q, rk) / 2) as w from r) select query, round(sum(w * (k[1] + 2 * k[2] + 3 * k[3] + 4 * k[4])) / sum(w), 5) as moment from e group by 1""")
def _(spark, d):
    w = _window(spark, d).withColumn("q", T.rotary(F.col("q"), F.col("i"), 4)).withColumn("k", T.rotary(F.col("k"), F.col("ki"), 4))
    return _digest(T.attend(w, 4))


@query("vec_attention_moe", f"""with g as (select vec_id, unnest([[x[1], 0], [x[2], 1], [x[3], 2], [x[4], 3]]) as g from (select vec_id, {DBL} as x from embeddings)), r as (select vec_id, g[2]::bigint as expert, g[1] as s, row_number() over (partition by vec_id order by g[1] desc, g[2]) as i from g)
    select vec_id as id, expert, round(exp(s) / sum(exp(s)) over (partition by vec_id), 6) as weight from r where i <= 2""")
def _(spark, d):
    gates = [[float(i == j) for j in range(64)] for i in range(4)]
    found = T.route(_emb(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), gates)
    return found.select("id", F.col("expert").cast("long").alias("expert"), r6("weight").alias("weight"))


RING = "e as (select vec_id as src, (vec_id + s) % (select count(*) from embeddings) as dst from embeddings, (values (1), (7), (31)) t(s))"


@query("vec_graph_attention", f"""with {RING}, p as (select src, b.embedding[1:4]::double[] as x, list_inner_product(a.embedding[1:4]::double[], b.embedding[1:4]::double[]) as w from e join embeddings a on src = a.vec_id join embeddings b on dst = b.vec_id),
    u as (select src, unnest([1, 2, 3, 4]) as i, unnest(x) as x, w from p), z as (select src, i, sum(w * x) / case when sum(w) > 0 then sum(w) else 1 end as x from u group by all)
    select src as node, round(sum(i * case when x > 0 then x else 0.01 * x end), 5) as moment from z group by 1""")
def _(spark, d):
    e = _emb(spark, d)
    n = e.count()
    edges = e.select(F.col("vec_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("s")).select("src", ((F.col("src") + F.col("s")) % n).alias("dst"))
    out = T.graph_attention(e.select(F.col("vec_id").alias("node"), F.slice("embedding", 1, 4).alias("v")), edges, 4)
    return _digest(out.withColumnRenamed("node", "query")).withColumnRenamed("query", "node")


@query("vec_gnn_search", f"with {Q0}, t as (select vec_id, list_cosine_similarity({DBL}, q) as s from embeddings, q order by s desc, vec_id limit 10) select vec_id, round(exp(s / 0.1) / sum(exp(s / 0.1)) over (), 6) as weight from t")
def _(spark, d):
    e = _emb(spark, d)
    top = V.knn(e, V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 10)
    w = F.exp(F.col("score") / 0.1)
    return top.crossJoin(F.broadcast(top.agg(F.sum(w).alias("total")))).select("vec_id", r6(w / F.col("total")).alias("weight"))


# ---------------------------------------------------------------- approximate search


@query("ann_lsh_multiprobe")
def _(spark, d):
    """Candidates of the query set over all buckets and their one-bit neighbours, counted."""
    e = _emb(spark, d)
    asked = I.probes(I.lsh_hash(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64)).withColumnRenamed("id", "query")
    return asked.join(I.lsh_hash(e, "vec_id", "embedding", 64), ["table", "bucket"]).where("id <> query").select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("n"))


@query("ann_lsh_rerank")
def _(spark, d):
    """Exact scores of the hashed candidates; with all tables the first ranks agree with exact search (recall is tested)."""
    e = _emb(spark, d)
    return I.lsh_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64, 10).where("rank <= 5")


# ---------------------------------------------------------------- ranking and recommendations


@query("rank_shard_rerank", f"with {Q0} select vec_id, round(0.7 * list_cosine_similarity({DBL}, q) + 0.3 * (label / 10), 6) as score from embeddings, q")
def _(spark, d):
    return _emb(spark, d).select("vec_id", r6(0.7 * V.cosine("embedding", _q0(spark, d)) + 0.3 * (F.col("label") / 10)).alias("score"))


@query("rank_semantic_score", "select l_orderkey, l_linenumber::bigint as line, round(l_quantity + (1 - l_discount) * 0.3 + (1 - l_tax) * 0.2 + exp(-l_linenumber) * 0.1, 6) as score from lineitem")
def _(spark, d):
    s = F.col("l_quantity") + (1 - F.col("l_discount")) * 0.3 + (1 - F.col("l_tax")) * 0.2 + F.exp(-F.col("l_linenumber").cast("double")) * 0.1
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), r6(s).alias("score"))


@query("rank_diversity_penalty", f"""with {PAIRS}, r as (select * from t where rank <= 10), x as (select a.query, a.id, a.score, coalesce(sum(0.5 * (s - 0.1)) filter (s > 0.1), 0) as lost from
    (select a.query, a.id, a.score, b.id as other, list_cosine_similarity(x.{DBL}, y.{DBL}) as s from r a left join r b on a.query = b.query and b.rank < a.rank left join embeddings x on x.vec_id = a.id left join embeddings y on y.vec_id = b.id) a group by all) select query, id, round(score * (1 - lost), 6) as score from x""")
def _(spark, d):
    top = _top(spark, d, 10).join(_emb(spark, d).select(F.col("vec_id").alias("id"), "embedding"), "id")
    held = top.select(F.col("query").alias("of"), F.col("rank").alias("above"), F.col("embedding").alias("seen"))
    over = V.cosine("embedding", "seen") - 0.1
    lost = top.join(held, (F.col("query") == F.col("of")) & (F.col("above") < F.col("rank")), "left").groupBy("query", "id", "score").agg(F.sum(F.when(over > 0, 0.5 * over).otherwise(0.0)).alias("lost"))
    return lost.select("query", "id", r6(F.col("score") * (1 - F.coalesce("lost", F.lit(0.0)))).alias("score"))


@query("rec_collaborative", f"""with {RA}, u as (select distinct user_id, item_id from ra), n as (select item_id, count(*) as n from u group by 1), c as (select a.item_id as a, b.item_id as b, count(*) as n from u a join u b on a.user_id = b.user_id and a.item_id <> b.item_id where a.item_id % 50 = 0 group by all)
    select a, b, round(c.n / sqrt(x.n * y.n), 6) as score from c join n x on x.item_id = a join n y on y.item_id = b where c.n >= 2""")
def _(spark, d):
    """Items bought by the same users as each item of the query set, by cosine of their user sets."""
    u = ratings(spark, d).select("user_id", "item_id").distinct()
    n = u.groupBy("item_id").agg(F.count("*").alias("n"))
    c = u.where("item_id % 50 = 0").select("user_id", F.col("item_id").alias("a")).join(u.withColumnRenamed("item_id", "b"), "user_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both")).where("both >= 2")
    c = c.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return c.select("a", "b", r6(F.col("both") / F.sqrt(F.col("na") * F.col("nb"))).alias("score"))


@query("rec_content", f"with {PAIRS} select query, id, round(0.8 * score + 0.2 * (ql = label)::int, 6) as score from t where rank <= 20")
def _(spark, d):
    lab = _emb(spark, d).select("vec_id", "label")
    j = _top(spark, d, 20).join(lab.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(lab.select(F.col("vec_id").alias("id"), "label"), "id")
    return j.select("query", "id", r6(0.8 * F.col("score") + 0.2 * (F.col("ql") == F.col("label")).cast("int")).alias("score"))


@query("rec_explain_action", f"""with {EP}, r as (select *, row_number() over (order by ts desc, id desc) as i from ep), t as (select task, reward, success, id, row_number() over (order by abs(reward - 0.5), id) as k from r where i <= 100)
    select task, round(count(*) / 10, 6) as share, round(avg(reward), 6) as reward, round(avg(success::int), 6) as success, array_to_string(list(id order by k)[:3], ',') as evidence from t where k <= 10 group by 1""")
def _(spark, d):
    """Actions among the 10 states nearest to reward one half of the latest 100, with shares and evidence."""
    latest = episodes(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(100)
    top = latest.withColumn("gap", F.abs(F.col("reward") - 0.5)).orderBy("gap", "id").limit(10)
    evidence = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("gap", "id"))), 1, 3), lambda x: x["id"].cast("string"))
    return top.groupBy("task").agg(r6(F.count("*") / 10).alias("share"), r6(F.avg("reward")).alias("reward"), r6(F.avg(F.col("success").cast("int"))).alias("success"), F.array_join(evidence, ",").alias("evidence"))


@query("rec_transfer", f"with {EP} select id, 'transfer:' || task as task, round(reward, 6) as reward from ep join embeddings on vec_id = id % (select count(*) from embeddings), (select embedding as e0 from embeddings where vec_id = 0) where list_cosine_similarity({DBL}, e0::double[]) >= 0.2")
def _(spark, d):
    near = _emb(spark, d).where(V.cosine("embedding", _q0(spark, d)) >= 0.2).select("vec_id")
    return episodes(spark, d).withColumn("vec_id", F.col("id") % _emb(spark, d).count()).join(near, "vec_id").select("id", F.concat(F.lit("transfer:"), "task").alias("task"), r6("reward").alias("reward"))


@query("vec_consolidate")
def _(spark, d):
    """Leaders of each label's vectors at similarity over 0.2, their members counted, and the unit centroid's first entry."""
    e = _emb(spark, d)
    m = V.consolidate(e, "label", "vec_id", "embedding", 0.2).join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    key = F.struct("group", "leader")
    centre = mean_vector(m.withColumn("key", key), "key", "embedding", dims=V.dims_of(e)).select("key.*", V.unit("vector").alias("centroid"))
    return m.groupBy("group", "leader").agg(F.count("*").alias("n")).join(centre, ["group", "leader"]).select("group", "leader", "n", r6(F.get("centroid", F.lit(0))).alias("first"))


@query("rank_mmr_meta")
def _(spark, d):
    """Diversity by metadata: the label as a one-hot vector makes the similarity 1 for equal labels and 0 for others."""
    lab = _emb(spark, d).select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double")).alias("v"))
    return R.mmr(_top(spark, d, 20).join(lab, "id").select("query", "id", "score", "v"), 5)


@query("g_conceptual", "with e as (select distinct l_orderkey as src, l_suppkey as concept from lineitem), n as (select concept, count(*) - 1 as others from e group by 1) select src as a, concept, others from e join n using (concept) where src % 50 = 0 and others > 0")
def _(spark, d):
    """The concepts of each node of the query set and how many others each one leads to; a concept stands for its pairs."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("concept")).distinct()
    size = e.groupBy("concept").agg((F.count("*") - 1).alias("others"))
    return e.where("src % 50 = 0").join(size, "concept").where("others > 0").select(F.col("src").alias("a"), "concept", "others")


@query("g_hyper_deps", "select event_type as stage, nxt as next, count(*) as n from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null group by all")
def _(spark, d):
    """Which stage follows which in a session's pipeline."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.lead("event_type").over(w).alias("next")).where("next is not null")
    return e.groupBy("stage", "next").agg(F.count("*").alias("n"))


@query("rec_hybrid", f"with {PAIRS}, pop as (select l_partkey as id, count(*) as n from lineitem group by 1) select query, t.id, round(0.7 * score + 0.3 * coalesce(n, 0) / (select max(n) from pop), 6) as score from t left join pop using (id) where rank <= 20")
def _(spark, d):
    """Content similarity with popularity over the most popular item's."""
    pop = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    top = pop.agg(F.max("n")).first()[0] or 1
    return _top(spark, d, 20).join(pop, "id", "left").select("query", "id", r6(0.7 * F.col("score") + 0.3 * F.coalesce("n", F.lit(0)) / F.lit(top)).alias("score"))


@query("rec_context", f"""with {PAIRS}, pop as (select l_partkey as id, count(*) as n from lineitem group by 1), h as (select query, t.id, 0.7 * score + 0.3 * coalesce(n, 0) / (select max(n) from pop) as score from t left join pop using (id) where rank <= 20),
    c as (select query, id, score * case when p_size <= 20 then 1.1 else 1 end as score from h left join part on p_partkey = id) select query, id, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, id) as i from c) where i <= 10""")
def _(spark, d):
    """Hybrid recommendations weighted by the context: on a mobile device, small items gain a tenth; the ten best of each query."""
    pop = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    top = pop.agg(F.max("n")).first()[0] or 1
    size = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    base = _top(spark, d, 20).drop("rank").join(pop, "id", "left").join(size, "id", "left")
    fit = F.when(F.col("p_size") <= 20, 1.1).otherwise(1.0)
    scored = base.withColumn("score", (0.7 * F.col("score") + 0.3 * F.coalesce("n", F.lit(0)) / F.lit(top)) * fit)
    return G.top_per(scored, "query", 10, F.desc("score"), "id").select("query", "id", r6("score").alias("score"))


@query("sup_ruvector", f"with {Q0} select vec_id from embeddings, q where vec_id <> 0 and label in (1, 2, 3) order by list_cosine_similarity({DBL}, q) desc, vec_id limit 5")
def _(spark, d):
    e = _emb(spark, d)
    return V.knn(e.where("label in (1, 2, 3)"), V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 5, exclude=0).select("vec_id")


@query("ann_unified")
def _(spark, d):
    """Hash, candidates, exact scores, top-k in one plan."""
    e = _emb(spark, d)
    return I.lsh_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64, 10)


@query("sup_greedy_nav", f"""with recursive {RING}, q as (select vec_id as query, {DBL} as q from embeddings where vec_id % 50 = 0), g as (select query, vec_id as node, list_distance({DBL}, q) as gap from embeddings, q),
    n as (select a.query, a.node, arg_min(b.node, (b.gap, b.node)) as next from g a join e on src = a.node join g b on b.query = a.query and b.node = dst where b.gap < a.gap group by all),
    w as (select query, 7::bigint as node, 0 as hops from q union all select w.query, next, hops + 1 from w join n on n.query = w.query and n.node = w.node where hops < 50)
    select query, arg_max(node, hops)::bigint as node, max(hops)::bigint as hops from w group by 1""")
def _(spark, d):
    """Walks of the whole query set from one node, each hop to the neighbour nearest to the query, at most 50 hops."""
    e = _emb(spark, d)
    n = e.count()
    edges = e.select(F.col("vec_id").alias("src"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("s")).select("src", ((F.col("src") + F.col("s")) % n).alias("dst"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return G.greedy_walks(edges, e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v")), asked, 7).select("query", "node", F.col("hops").cast("long").alias("hops"))
