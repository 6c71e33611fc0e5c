"""Indexes, formats, ordered operators and supplementary rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import scalars as S
from skein.operators import indexes as I
from skein.operators import sequential as Q
from skein.operators import vectors as V
from skein.operators.graph import top_per
from skein.operators.ranking import knn_batch
from skein.plans.registry import query
from skein.plans.scratch import materialise, scratch_path
from skein.sources import formats
from skein.sources.tables import table
from skein.sources.views import EP, LK, RA, episodes, links, ratings

r6 = lambda c: F.round(c, 6)


def _by_session():
    return Window.partitionBy("session_id").orderBy("ts", "id")


@query("ann_lsh_hash")
def _(spark, d):
    return I.lsh_hash(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("ann_lsh_search")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return I.lsh_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64, 10)


@query("ann_recall")
def _(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    found = I.lsh_search(e, asked, "vec_id", "embedding", 64, 10)
    return spark.createDataFrame([(I.recall(found, knn_batch(e, asked, "vec_id", "embedding", 10), 10),)], "recall double")


@query("ann_pq_adc")
def _(spark, d):
    e = table(spark, d, "embeddings")
    pq = I.ProductQuantizer().fit(e, "vec_id", "embedding")
    return pq.distances(pq.encode(e, "vec_id", "embedding"), V.vector_of(e, "vec_id", 0)).orderBy("distance", "id").limit(10)


@query("src_csv", "select p_partkey, p_name, p_retailprice from part where p_size > 10")
def _(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).csv(path)
    return formats.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("src_jsonl", "select c_custkey, c_name, c_acctbal from customer")
def _(spark, d):
    path = scratch_path(spark, "json")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return formats.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("src_turtle", "select 'http://x/part/' || p_partkey as s, 'http://x/brand' as p, p_brand as o from part union all select 'http://x/part/' || p_partkey, 'http://x/type', p_type from part")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("http://x/part/"), F.col("p_partkey").cast("string")).alias("s"), F.explode(F.create_map(F.lit("http://x/brand"), "p_brand", F.lit("http://x/type"), "p_type")).alias("p", "o"))
    path = scratch_path(spark, "turtle")
    formats.to_turtle(p).select("turtle").write.text(path)
    return formats.read_turtle(spark, path).select("s", "p", "o")


@query("sink_graph_merge", "select distinct p_partkey as src, tag from (select p_partkey, unnest(string_split(p_name, ' ')) as tag from part)")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(F.split("p_name", " ")).alias("tag")).dropDuplicates(["src", "tag"])


@query("sink_vector", "select vec_id, label::bigint as label from embeddings")
def _(spark, d):
    path = scratch_path(spark, "vectors")
    formats.write_partitioned(table(spark, d, "embeddings"), path, "label")
    return spark.read.parquet(path).select("vec_id", F.col("label").cast("long").alias("label"))


@query("math_qlearning")
def _(spark, d):
    e = episodes(spark, d)
    steps = e.select(F.col("session_id").alias("session"), F.row_number().over(_by_session()).alias("at"), F.coalesce(F.lag("task").over(_by_session()), F.lit("start")).alias("state"), F.col("task").alias("action"), "reward", F.col("task").alias("next_state"))
    return Q.q_learning(steps)


@query("math_bandit_update", f"""with {EP}, o as (select task, reward as r, row_number() over w as i, coalesce(avg(reward) over (partition by task order by ts, id rows between unbounded preceding and 1 preceding), 0) as m, count(*) over (partition by task) as n from ep window w as (partition by task order by ts, id))
    select task, max(n) as n, round(avg(r), 6) as mean, round(sum(0.1 * power(0.9, n - i) * abs(r - m)) + power(0.9, max(n)), 6) as spread from o group by 1""")
def _(spark, d):
    return Q.bandit(episodes(spark, d), "task", ["ts", "id"], "reward").select("task", "n", r6("mean").alias("mean"), r6("spread").alias("spread"))


_COVER = "".join(
    f", m{i} as (select query, arg_max(chunk, (n, -chunk)) as chunk from (select query, chunk, count(*) as n from c{i} group by all) group by 1)"
    f", c{i + 1} as (select * from c{i} where (query, requirement) not in (select c.query, c.requirement from c{i} c join m{i} m on c.query = m.query and c.chunk = m.chunk))"
    for i in range(5)
)


@query("p_hitting_set", f"""with c0 as (select distinct l_orderkey as query, l_linenumber::bigint as chunk, unnest([(l_partkey % 5)::varchar, (l_suppkey % 5)::varchar]) as requirement from lineitem){_COVER}
    select query, chunk, step::bigint as step from ({" union all ".join(f"select *, {i + 1} as step from m{i}" for i in range(5))})""")
def _(spark, d):
    cover = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").cast("long").alias("chunk"), F.explode(F.array((F.col("l_partkey") % 5).cast("string"), (F.col("l_suppkey") % 5).cast("string"))).alias("requirement"))
    return Q.hitting_set(cover)


@query("sup_irv_vote")
def _(spark, d):
    ballots = episodes(spark, d).groupBy("session_id", "task").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "task"))), lambda x: x["task"]).alias("choices"))
    return spark.createDataFrame(Q.instant_runoff(materialise(ballots, "ballots")), "round int, candidate string, votes long, eliminated boolean")


@query("math_softmax", f"with {EP}, m as (select session_id, id, exp(reward - max(reward) over (partition by session_id)) as e from ep) select id, round(e / sum(e) over (partition by session_id), 6) as p from m")
def _(spark, d):
    w = Window.partitionBy("session_id")
    m = episodes(spark, d).select("session_id", "id", F.exp(F.col("reward") - F.max("reward").over(w)).alias("e"))
    return m.select("id", r6(F.col("e") / F.sum("e").over(w)).alias("p"))


@query("math_js_kl", "select p_partkey, round(0.5 * (p * log2(2 * p / (p + 0.25)) + (1 - p) * log2(2 * (1 - p) / (1 - p + 0.75)) + 0.25 * log2(0.5 / (p + 0.25)) + 0.75 * log2(1.5 / (1 - p + 0.75))), 6) as js from (select p_partkey, p_size / 60.0::double as p from part)")
def _(spark, d):
    p = F.col("p_size") / 60
    return table(spark, d, "part").select("p_partkey", r6(S.js(F.array(p, 1 - p), F.array(F.lit(0.25), F.lit(0.75)))).alias("js"))


@query("math_clamp", "select c_custkey, greatest(0, least(5000, c_acctbal)) as v from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("v"))


@query("math_doubly_robust", f"""with {EP}, m as (select task, avg(reward) filter (latency > 50) as mu1, avg(reward) filter (latency <= 50) as mu0, greatest(0.01, least(0.99, avg((latency > 50)::int))) as p from ep group by 1)
    select id, round((mu1 - mu0) + (reward - mu1) / p, 5) as effect from ep join m using (task) where latency > 50""")
def _(spark, d):
    e = episodes(spark, d)
    slow = F.col("latency") > 50
    m = e.groupBy("task").agg(F.avg(F.when(slow, F.col("reward"))).alias("mu1"), F.avg(F.when(~slow, F.col("reward"))).alias("mu0"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg(slow.cast("int")))).alias("p"))
    return e.where(slow).join(m, "task").select("id", F.round(S.doubly_robust(F.col("mu1"), F.col("mu0"), F.col("reward"), F.col("p")), 5).alias("effect"))


@query("arr_map_jaccard", "select p_partkey, round(((p_type = 'ECONOMY')::int + (p_brand = 'Brand#2')::int) / 2, 6) as j from part")
def _(spark, d):
    mine = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    want = F.create_map(F.lit("type"), F.lit("ECONOMY"), F.lit("brand"), F.lit("Brand#2"))
    return table(spark, d, "part").select("p_partkey", r6(S.map_jaccard(mine, want)).alias("j"))


@query("arr_slice", "select doc_id, substr(text, 1, 200) as head from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("head"))


@query("str_requirements", "select event_id, array_to_string(['find', 'episode', event_type], ' ') as words from events where length(event_type) > 3")
def _(spark, d):
    text = F.concat(F.lit("Find the episode, with the find "), F.col("event_type"), F.lit("!"))
    return table(spark, d, "events").where("length(event_type) > 3").select("event_id", F.array_join(S.requirements(text, ["with"]), " ").alias("words"))


@query("topk_str_genome", "select item, string_agg(tag::varchar, ',' order by s desc, tag) as tags from (select *, row_number() over (partition by item order by s desc, tag) as rn from (select l_partkey as item, l_suppkey as tag, max(l_quantity) as s from lineitem group by all)) where rn <= 3 group by 1")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("tag")).agg(F.max("l_quantity").alias("s"))
    g = top_per(s, "item", 3, F.desc("s"), "tag").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("x"))
    return g.select("item", F.array_join(F.transform("x", lambda v: v["tag"].cast("string")), ",").alias("tags"))


@query("sup_herding", f"with {EP} select ts::date as day, greatest(count(*) filter (task = 'purchase'), count(*) filter (task = 'error')) / (count(*) filter (task in ('purchase', 'error')) + 1) > 0.6 as herding from ep group by 1")
def _(spark, d):
    """Days on which more than 0.6 of the orders go one way; purchases buy, errors sell, and one is added to their number."""
    buy, sell = F.count_if(F.col("task") == "purchase"), F.count_if(F.col("task") == "error")
    return episodes(spark, d).groupBy(F.to_date("ts").alias("day")).agg((F.greatest(buy, sell) / (buy + sell + 1) > 0.6).alias("herding"))


@query("sup_degradation", f"with {EP} select id, latency / first_value(latency) over (partition by session_id order by ts, id) > 1.2 as degraded from ep where latency > 0")
def _(spark, d):
    e = episodes(spark, d).where("latency > 0")
    return e.select("id", (F.col("latency") / F.first("latency").over(_by_session()) > 1.2).alias("degraded"))


@query("sup_forecast", f"""with {EP}, l as (select session_id, reward, row_number() over (partition by session_id order by ts desc, id desc) as rn from ep), f as (select session_id, max(reward) filter (rn = 1) as last, max(reward) filter (rn = 5) as first from l where rn <= 5 group by 1 having count(*) = 5)
    select session_id, step, round(last + (last - first) / 5 * step, 6) as value from f, range(1, 4) t(step)""")
def _(spark, d):
    l = top_per(episodes(spark, d), "session_id", 5, F.desc("ts"), F.desc("id"))
    f = l.groupBy("session_id").agg(F.max(F.when(F.col("rank") == 1, F.col("reward"))).alias("last"), F.max(F.when(F.col("rank") == 5, F.col("reward"))).alias("first"), F.count("*").alias("n")).where("n = 5")
    f = f.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return f.select("session_id", "step", r6(F.col("last") + (F.col("last") - F.col("first")) / 5 * F.col("step")).alias("value"))


@query("sup_fragmentation", f"with {LK} select p_partkey as node from part where p_partkey % 5 > 0 and p_partkey not in (select src from lk where dst % 5 > 0 union select dst from lk where src % 5 > 0)")
def _(spark, d):
    e = links(spark, d)
    live = e.where("dst % 5 > 0").select(F.col("src").alias("node")).union(e.where("src % 5 > 0").select("dst")).distinct()
    return table(spark, d, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("node")).join(live, "node", "left_anti")


@query("sup_batch_filter", f"with {RA} select user_id, round(avg(rating), 6) as mean, count(*) as n from ra where rating >= 3 group by 1 order by avg(rating) desc, user_id limit 25")
def _(spark, d):
    g = ratings(spark, d).where("rating >= 3").groupBy("user_id").agg(F.avg("rating").alias("m"), F.count("*").alias("n"))
    return g.orderBy(F.desc("m"), "user_id").limit(25).select("user_id", r6("m").alias("mean"), "n")


@query("sup_fusion", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: (0.5 * x + 0.3 * abs(x) + 0.2 * x * x) / 1.0)), 5) as s from embeddings")
def _(spark, d):
    w = [0.5, 0.3, 0.2]
    fused = F.transform(F.col("embedding").cast("array<double>"), lambda x: (w[0] * x + w[1] * F.abs(x) + w[2] * x * x) / sum(w))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(fused, F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@query("join_skill_links", "select src, string_agg(dst::varchar, ',' order by weight, dst) filter (dst % 3 = 0) as prerequisites, string_agg(dst::varchar, ',' order by weight desc, dst) filter (dst % 3 = 1) as alternatives from (with " + LK + " select * from lk) group by 1")
def _(spark, d):
    def listed(k, key):
        own = F.filter(F.array_sort(F.collect_list(F.when(F.col("dst") % 3 == k, F.struct(key.alias("k"), "dst")))), lambda x: x.isNotNull())
        text = F.array_join(F.transform(own, lambda x: x["dst"].cast("string")), ",")
        return F.nullif(text, F.lit(""))

    return links(spark, d).groupBy("src").agg(listed(0, F.col("weight")).alias("prerequisites"), listed(1, -F.col("weight")).alias("alternatives"))


@query("join_availability", "select p_partkey, s_name, min(l_extendedprice / l_quantity) as price from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_partkey", "s_name").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query("rank_hybrid_onto", "with q as (select embedding::double[] as q, label as ql from embeddings where vec_id = 0) select vec_id, round(0.7 * list_cosine_similarity(embedding::double[], q) + 0.2 * (label = ql)::int + 0.1 * (label % 3 = ql % 3)::int, 6) as score from embeddings, q where vec_id <> 0")
def _(spark, d):
    e = table(spark, d, "embeddings")
    own = e.where("vec_id = 0").select("embedding", "label").first()
    same = (F.col("label") == own[1]).cast("int")
    kin = (F.col("label") % 3 == own[1] % 3).cast("int")
    return e.where("vec_id <> 0").select("vec_id", r6(0.7 * V.cosine("embedding", F.array(*[F.lit(float(x)) for x in own[0]])) + 0.2 * same + 0.1 * kin).alias("score"))


@query("rank_features", f"with {EP}, b as (select min(reward) as a1, max(reward) as b1, min(latency) as a2, max(latency) as b2 from ep) select id, round(0.6 * (reward - a1) / (b1 - a1) + 0.4 * (1 - (latency - a2) / (b2 - a2)), 6) as score from ep, b")
def _(spark, d):
    e = episodes(spark, d)
    a1, b1, a2, b2 = e.agg(F.min("reward"), F.max("reward"), F.min("latency"), F.max("latency")).first()
    return e.select("id", r6(0.6 * (F.col("reward") - a1) / (b1 - a1) + 0.4 * (1 - (F.col("latency") - a2) / (b2 - a2))).alias("score"))


@query("rank_personalised", "select p_partkey, round(0.1::double * len(string_split(p_name, ' ')) - 0.5 * contains(p_name, 'red')::int + 0.2 * contains(p_name, 'ring')::int - 0.3 * (p_size > 40)::int, 6) as score from part")
def _(spark, d):
    has = lambda w: F.col("p_name").contains(w).cast("int")
    s = 0.1 * F.size(F.split("p_name", " ")) - 0.5 * has("red") + 0.2 * has("ring") - 0.3 * (F.col("p_size") > 40).cast("int")
    return table(spark, d, "part").select("p_partkey", r6(s).alias("score"))


@query("o_equivalence", "with e as (select c_custkey as a, c_custkey + 1 as b from customer where c_custkey % 4 <> 3), s as (select a, b from e union select b, a from e), t as (select x.a, y.b from s x join s y on x.b = y.a where x.a <> y.b union select * from s) select * from t except select * from e")
def _(spark, d):
    """Symmetric closure and one transitive step, less what was asserted: customers in runs of four."""
    e = table(spark, d, "customer").where("c_custkey % 4 <> 3").selectExpr("c_custkey as a", "c_custkey + 1 as b")
    both = e.union(e.select("b", "a"))
    step = both.join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", F.col("c").alias("b"))
    return both.union(step).distinct().join(e, ["a", "b"], "left_anti")


@query("o_rdf_map", "select p_partkey as s, 'size' as p, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as o, 0.9::double as confidence from part union all select p_partkey, 'kind', lower(p_type), case when p_type = 'PROMO' then 0.6 else 0.8 end from part")
def _(spark, d):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    t = F.array(F.struct(F.lit("size").alias("p"), size.alias("o"), F.lit(0.9).alias("confidence")), F.struct(F.lit("kind").alias("p"), F.lower("p_type").alias("o"), F.when(F.col("p_type") == "PROMO", 0.6).otherwise(0.8).alias("confidence")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("s"), F.explode(t).alias("t")).select("s", "t.*")


@query("p_reason", f"with {EP} select id, case when reward > 0.5 then 'high' when reward > 0.1 then 'medium' else 'low' end as reason from ep")
def _(spark, d):
    return episodes(spark, d).select("id", F.when(F.col("reward") > 0.5, "high").when(F.col("reward") > 0.1, "medium").otherwise("low").alias("reason"))


@query("p_verify", "select doc_id, doc_id % 10 <> 0 as intact from documents")
def _(spark, d):
    """Stored hashes against texts of which every tenth was changed since."""
    docs = table(spark, d, "documents")
    stored = docs.select(F.col("doc_id").alias("of"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    now = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.join(stored, F.col("doc_id") == F.col("of")).select("doc_id", (F.sha2(now.cast("binary"), 256) == F.col("h")).alias("intact"))
