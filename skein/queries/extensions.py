"""Search fronts, text embeddings, evaluation, frontiers, communities, stores, functions of the schema and tools."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import api
from skein.operators import filters
from skein.operators import graph as G
from skein.operators import indexes as I
from skein.operators import ranking as R
from skein.operators import text as X
from skein.operators import vectors as V
from skein.plans.ordered import running
from skein.plans.registry import query
from skein.plans.scratch import scratch_path
from skein.queries.search import DBL, PAIRS, Q0
from skein.sources.tables import table
from skein.sources.views import ED, EP, LK, RA, causal_edges, episodes, links, ratings

r6 = lambda c: F.round(c, 6)


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _asked(spark, d):
    return _emb(spark, d).where("vec_id % 50 = 0")


# ---------------------------------------------------------------- filters


@query("flt_safe_where", "select p_partkey from part where p_type = 'PROMO' and p_size = 10")
def _(spark, d):
    return filters.safe_where(table(spark, d, "part"), {"part": ("p_type", "p_size", "p_brand")}, "part", {"p_type": "PROMO", "p_size": 10}).select("p_partkey")


_SPEC = """case p_size % 5 when 0 then '{"size":{"$in":[' || p_size || ',2]}}' when 1 then '{"size":{"$in":' || p_size || '}}' when 2 then '[' || p_size || ']' when 3 then '{"brand":"' || p_brand || '"}' else '{"a":{"$gt":1},"b":{"$nin":"x"}}' end"""


@query("flt_validate", f"""with s as (select p_partkey, {_SPEC} as spec from part)
    select p_partkey, json_type(spec) = 'OBJECT' and coalesce(json_type(spec, '$.size."$in"'), 'ARRAY') = 'ARRAY' and coalesce(json_type(spec, '$.b."$nin"'), 'ARRAY') = 'ARRAY' as valid from s""")
def _(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_SPEC} as spec").select("p_partkey", filters.valid_filter(F.col("spec")).alias("valid"))


# ---------------------------------------------------------------- similarity of pairs and fronts of the search kernel


@query("join_pair_similarity", f"select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.{DBL}, b.{DBL}), 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.{DBL}, b.{DBL}) >= 0.35")
def _(spark, d):
    """Unordered pairs over a threshold; only these leave a task."""
    e = _emb(spark, d)
    return R.similar_pairs(e, e, "vec_id", "embedding", 0.35, once=True).select(F.col("query").alias("a"), F.col("id").alias("b"), r6("score").alias("score"))


@query("knn_pairwise_matrix", f"with {PAIRS} select query, id, round(score, 6) as score from p where score >= 0.2")
def _(spark, d):
    """The entries of 0.2 and more in the rows of the query set."""
    return R.similar_pairs(_emb(spark, d), _asked(spark, d), "vec_id", "embedding", 0.2).select("query", "id", r6("score").alias("score"))


@query("sup_matrix_rows", f"with {PAIRS} select query, id, round(score, 6) as score, rank::bigint as rank from t where rank <= 3")
def _(spark, d):
    """The three greatest entries in each row of the query set."""
    top = R.knn_batch(_emb(spark, d), _asked(spark, d), "vec_id", "embedding", 3)
    return top.select("query", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("sup_gpu_pairwise", f"with n as (select count(*) as n from embeddings) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.{DBL}, b.{DBL}), 6) as score from embeddings a, n join embeddings b on b.vec_id = (a.vec_id + 1) % n")
def _(spark, d):
    """Rows of two aligned tables, compared one by one."""
    e = _emb(spark, d)
    left = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), ((F.col("vec_id") + 1) % e.count()).alias("b"))
    return left.join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b").select("a", "b", r6(V.cosine("x", "y")).alias("score"))


@query("sup_knn_pipeline", f"with {PAIRS} select query, id, rank::bigint as rank from t where rank <= 5 and score >= 0.1")
def _(spark, d):
    return R.KnnPipeline(_emb(spark, d), "vec_id", "embedding").k(5).at_least(0.1).batch(_asked(spark, d)).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("topk_torch", f"with x as (select vec_id, unnest({DBL}) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings), r as (select *, row_number() over (partition by vec_id order by x desc, i) as n from x) select vec_id, string_agg(i::varchar, ',' order by n) as places from r where n <= 3 group by 1")
def _(spark, d):
    """The places of the three greatest entries of each row."""
    ranked = F.array_sort(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.struct((-x).alias("low"), i.alias("i"))))
    return _emb(spark, d).select("vec_id", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["i"].cast("string")), ",").alias("places"))


@query("topk_gpu", f"with {EP} select session_id, id from (select *, row_number() over (partition by session_id order by reward desc, id) as i from ep) where i <= 3")
def _(spark, d):
    return G.top_per(episodes(spark, d), "session_id", 3, F.desc("reward"), "id").select("session_id", "id")


# ---------------------------------------------------------------- indexes


@query("ann_pq_train")
def _(spark, d):
    """Centres of every part, trained on a bounded sample."""
    return I.ProductQuantizer().fit(_emb(spark, d), "vec_id", "embedding").codebooks(spark)


@query("ann_pq_decode")
def _(spark, d):
    """Distance of each vector to what its codes give back."""
    e = _emb(spark, d)
    pq = I.ProductQuantizer().fit(e, "vec_id", "embedding")
    return pq.decoded(pq.encode(e, "vec_id", "embedding")).join(e, F.col("id") == F.col("vec_id")).select("id", r6(V.l2("vector", "embedding")).alias("error"))


@query("ann_hnsw", f"""with h as (select case when vec_id % 7 = 0 then vec_id + 1000000 else vec_id end as id, {DBL} as v from embeddings where vec_id % 10 <> 3 or vec_id % 7 = 0), p as (select a.vec_id as query, id, list_cosine_similarity(a.{DBL}, v) as score from embeddings a join h on id <> a.vec_id where a.vec_id % 50 = 0)
    select query, id, rank::bigint as rank from (select *, row_number() over (partition by query order by round(score, 12) desc, id) as rank from p) where rank <= 5""")
def _(spark, d):
    """An index that rows are added to, removed from and renamed in; it is rebuilt once a tenth is gone, and search is exact."""
    e = _emb(spark, d)
    index = I.VectorIndex(spark).add(e, "vec_id", "embedding").remove(e.where("vec_id % 10 = 3 or vec_id % 7 = 0"), "vec_id")
    index.add(e.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000), "vec_id", "embedding")
    return index.search(_asked(spark, d), "vec_id", "embedding", 5).select("query", "id", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- text


@query("vec_mock_embed", """with c as (select doc_id, unnest(range(0, length(text))) as i, unnest(string_split(lower(text), '')) as ch from documents where length(text) > 0),
    b as (select doc_id, (unicode(ch) + i) % 64 as k, sum(sin(unicode(ch) / 10) * 0.1) as x from c group by all), m as (select doc_id, sum((k + 1) * x) as moment, sqrt(sum(x * x)) as n from b group by 1)
    select documents.doc_id, coalesce(round(moment / n, 5), 0) as moment from documents left join m on documents.doc_id = m.doc_id""")
def _(spark, d):
    moment = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return X.embed(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.round(moment, 5).alias("moment"))


@query("sup_find_most_similar", """with q as (select -1 as doc_id, 'release notes of the engine' as text), a as (select doc_id, text from documents union all select * from q), c as (select doc_id, unnest(range(0, length(text))) as i, unnest(string_split(lower(text), '')) as ch from a where length(text) > 0),
    b as (select doc_id, (unicode(ch) + i) % 64 as k, sum(sin(unicode(ch) / 10) * 0.1) as x from c group by all), n as (select doc_id, sqrt(sum(x * x)) as n from b group by 1),
    s as (select b.doc_id, sum(b.x * o.x) as dot from b join b o on o.doc_id = -1 and b.k = o.k where b.doc_id >= 0 group by 1)
    select s.doc_id, round(dot / n.n / (select n from n where doc_id = -1), 6) as similarity from s join n using (doc_id) order by round(dot / n.n / (select n from n where doc_id = -1), 9) desc, s.doc_id limit 5""")
def _(spark, d):
    return X.most_similar(table(spark, d, "documents"), "release notes of the engine", "doc_id", "text").select(F.col("id").alias("doc_id"), r6("similarity").alias("similarity"))


# ---------------------------------------------------------------- ranking


@query("eval_recall", f"with {PAIRS}, n as (select a.vec_id as query, count(*) as n from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1) select query, round(sum((ql = label)::int) / coalesce(max(n), 1), 6) as recall from t left join n using (query) where rank <= 10 group by 1")
def _(spark, d):
    e = _emb(spark, d)
    size = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    asked = _asked(spark, d).select(F.col("vec_id").alias("query"), F.col("label").alias("ql")).join(size, F.col("ql") == F.col("label")).drop("label")
    top = R.knn_batch(e, _asked(spark, d), "vec_id", "embedding", 10).join(asked, "query").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return R.recall_at(top.withColumn("relevant", F.col("ql") == F.col("label")), 10).select("query", r6("recall").alias("recall"))


@query("rank_rerank_column", f"with {PAIRS}, s as (select query, id, 0.7 * score + 0.3 * (label / 10) as s from t where rank <= 20) select query, id, round(s, 6) as score from (select *, row_number() over (partition by query order by s desc, id) as i from s) where i <= 5")
def _(spark, d):
    """A caller's expression takes 0.3 of the score."""
    top = R.knn_batch(_emb(spark, d), _asked(spark, d), "vec_id", "embedding", 20).join(_emb(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    return R.rerank(top, F.col("label") / 10, 5).select("query", "id", r6("score").alias("score"))


@query("vec_attention_rerank", f"""with {PAIRS}, c as (select query, id, rank, b.{DBL} as v, list_transform(a.{DBL}, lambda x, i: x + 0.3 * case i when 1 then 0.5 when 2 then 0.25 else 0 end) as q from t join embeddings a on a.vec_id = query join embeddings b on b.vec_id = id where rank <= 20),
    w as (select query, id, v, exp(list_inner_product(q, v) / 8) as w from c), s as (select query, sum(w) as total from w group by 1)
    select x.query, x.id, round(sum(y.w / total * list_inner_product(x.v, y.v)), 6) as score from w x join w y on x.query = y.query join s on s.query = x.query group by all""")
def _(spark, d):
    e = _emb(spark, d)
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = R.knn_batch(e, _asked(spark, d), "vec_id", "embedding", 20).select("query", "id").join(v, "id").join(v.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    return R.attention_scores(top, 64, [0.5, 0.25]).select("query", "id", r6("score").alias("score"))


@query("sup_gnn_enhance", f"""with {PAIRS}, c as (select query, greatest(score, 0) as w, b.{DBL} as v, a.{DBL} as q from t join embeddings a on a.vec_id = query join embeddings b on b.vec_id = id where rank <= 5),
    x as (select query, w, unnest(v) as v, unnest(q) as q, generate_subscripts(v, 1) as i from c), m as (select query, i, 0.5 * min(q) + 0.5 * sum(w * v) / sum(w) as x from x group by all)
    select query, round(sum(x * i) / sqrt(sum(x * x)), 5) as moment from m group by 1""")
def _(spark, d):
    """Each query drawn half way to the mean of its five neighbours, weighted by similarity."""
    e = _emb(spark, d)
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = R.knn_batch(e, _asked(spark, d), "vec_id", "embedding", 5).select("query", "id", F.col("score").alias("weight")).join(v, "id").join(v.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return R.enhance(top, 64).select("query", F.round(moment, 5).alias("moment"))


@query("rec_path", f"""with recursive {RA}, {LK}, l as (select user_id, item_id, max(ts) as ts from ra where user_id % 50 = 0 group by all), r as (select user_id, item_id from (select *, row_number() over (partition by user_id order by ts desc, item_id) as i from l) where i <= 3),
    p as (select user_id, dst as node, 1 as hops from r join lk on item_id = src union all select user_id, dst, hops + 1 from p join lk on node = src where hops < 2),
    b as (select user_id, node, min(hops) as hops from p where (user_id, node) not in (select user_id, item_id from l) group by all)
    select user_id, node, round(power(0.85, hops), 6) as score from b""")
def _(spark, d):
    """What two links at most lead to from the three latest items of each user of the query set, and they have not had."""
    own = ratings(spark, d).where("user_id % 50 = 0").groupBy("user_id", "item_id").agg(F.max("ts").alias("ts"))
    recent = G.top_per(own, "user_id", 3, F.desc("ts"), "item_id").select("user_id", F.col("item_id").alias("node"))
    e = links(spark, d).select(F.col("src").alias("s"), F.col("dst").alias("t"))
    one = recent.join(e, F.col("node") == F.col("s")).select("user_id", F.col("t").alias("node")).distinct()
    two = one.join(e, F.col("node") == F.col("s")).select("user_id", F.col("t").alias("node")).distinct()
    met = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).groupBy("user_id", "node").agg(F.min("hops").alias("hops"))
    return met.join(own.select("user_id", F.col("item_id").alias("node")), ["user_id", "node"], "left_anti").select("user_id", "node", r6(F.pow(F.lit(0.85), F.col("hops"))).alias("score"))


# ---------------------------------------------------------------- graphs


DIST = f"{LK}, s as (select 1::bigint as node, 0.0::double as dist, 0 as hops union select dst, dist + weight, hops + 1 from s join lk on node = src where hops < 12 and dist + weight <= 12), m as (select node, min(dist) as dist from s group by 1)"


def _near(spark, d, bound=12.0):
    return G.shortest(links(spark, d), spark.createDataFrame([(1,)], "n long"), bound=bound)


@query("g_frontier_partition", f"with recursive {DIST}, p as (select dist as pd, row_number() over (order by node) - 1 as place from (select * from m order by node limit 5)), g as (select node, arg_min(place, (abs(dist - pd), place)) as place from m, p group by 1) select node, place % 3 as part from g")
def _(spark, d):
    frontier = _near(spark, d).select("node", "dist")
    pivots = frontier.orderBy("node").limit(5).withColumn("place", F.row_number().over(Window.orderBy("node")) - 1)
    return G.nearest_pivots(frontier, pivots, 3).select("node", F.col("part").cast("long").alias("part"))


@query("g_frontier_compact", f"with {LK}, f as (select src as node, max(weight) >= 2 as flag from lk group by 1) select node, row_number() over (order by node) - 1 as place from f where flag")
def _(spark, d):
    """Places of the flagged nodes without gaps; numbers come from ranges and their offsets, not from one ordered task."""
    flagged = links(spark, d).groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("w")).where("w >= 2").select("node", F.lit(0).alias("all"))
    return running(flagged, ["all"], [F.col("node")], "n").select("node", (F.col("n") - 1).alias("place"))


@query("g_sssp_select", f"with {LK}, n as (select count(*) as nodes from (select src from lk union select dst from lk)), e as (select count(*) as edges from lk) select nodes, edges, case when nodes > 10000000 or (edges / nodes < log2(nodes) and nodes > 100000) then 'landmarks' else 'relax' end as plan from n, e")
def _(spark, d):
    e = links(spark, d)
    nodes, edges = e.select("src").union(e.select("dst")).distinct().count(), e.count()
    return spark.createDataFrame([(nodes, edges, G.choose_paths(nodes, edges))], "nodes long, edges long, plan string")


@query("sup_gpu_paths", f"with recursive {DIST} select node, round(dist, 6) as dist from m")
def _(spark, d):
    """Distances by the plan for the graph's size; at every size these are exact within the bound."""
    return _near(spark, d).select("node", r6("dist").alias("dist"))


@query("g_leiden")
def _(spark, d):
    return G.leiden(links(spark, d))


@query("g_spectral")
def _(spark, d):
    return G.spectral(links(spark, d), 4, rounds=12)


def _store(spark, d):
    nodes = _emb(spark, d).select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    return G.GraphStore(nodes, links(spark, d))


@query("g_backend_api", f"with recursive {LK}, {Q0}, w as (select 1::bigint as node, 0 as hops union select dst, hops + 1 from w join lk on node = src where hops < 6), n as (select distinct node from w where node <> 1) select vec_id as node, round(list_cosine_similarity({DBL}, q), 6) as score from embeddings join n on vec_id = node, q order by list_cosine_similarity({DBL}, q) desc, vec_id limit 5")
def _(spark, d):
    """The nodes most similar to a vector within six steps of node 1."""
    return _store(spark, d).vector_search(V.vector_of(_emb(spark, d), "vec_id", 0), 5, context=1, depth=6).select("node", r6("score").alias("score"))


@query("g_backend_traverse", f"with recursive {LK}, w as (select 1::bigint as node, 0 as hops union select dst, hops + 1 from w join lk on node = src where hops < 3) select node, min(hops)::bigint as hops from w where node <> 1 group by 1")
def _(spark, d):
    return _store(spark, d).traverse(1, 3).select("node", F.col("hops").cast("long").alias("hops"))


@query("sup_graph_nodes", f"with {EP}, {Q0}, e as (select id, 'episode' as kind from ep join embeddings on vec_id = id, q order by list_cosine_similarity({DBL}, q) desc, id limit 10), s as (select p_partkey as id, 'skill' as kind from part order by p_partkey limit 10) select * from e union all select * from s")
def _(spark, d):
    """A node store written and read back: episodes by vector similarity, skills as they are stored (their search takes no vector)."""
    path, e = scratch_path(spark, "nodes"), _emb(spark, d)
    held = episodes(spark, d).join(e, F.col("id") == F.col("vec_id")).select("id", F.lit("episode").alias("kind"), "embedding")
    held.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("skill").alias("kind"), F.lit(None).cast("array<float>").alias("embedding"))).write.partitionBy("kind").parquet(path)
    nodes = spark.read.parquet(path)
    near = V.knn(nodes.where("kind = 'episode'"), V.vector_of(e, "vec_id", 0), "id", "embedding", 10, keep=["kind"]).select("id", "kind")
    return near.unionByName(nodes.where("kind = 'skill'").orderBy("id").limit(10).select("id", "kind"))


# ---------------------------------------------------------------- stores and functions of the schema


@query("sup_rl_migrate", f"with {EP}, q as (select session_id, task, avg(reward) as q from ep group by all) select 'experiences' as kind, count(*) as n, round(sum(reward), 4) as total from ep union all select 'q_values', count(*), round(sum(q), 4) from q union all select 'policies', count(*), round(sum(best), 4) from (select session_id, max(q) as best from q group by 1)")
def _(spark, d):
    """Experiences, values and policies written in batches to a new store; what is counted there is the check."""
    path = scratch_path(spark, "state")
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    e = episodes(spark, d).withColumn("next_task", F.lead("task").over(w))
    values = e.groupBy("session_id", "task").agg(F.avg("reward").alias("q"))
    policies = values.groupBy("session_id").agg(F.max("q").alias("q"), F.max_by("task", F.struct("q", "task")).alias("action"))
    out = None
    for kind, rows, x in (("experiences", e, "reward"), ("q_values", values, "q"), ("policies", policies, "q")):
        rows.write.option("maxRecordsPerFile", 100_000).parquet(f"{path}/{kind}")
        one = spark.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum(x), 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fn_state_hash", "select event_id, sha256(user_id || ':' || event_type) as state from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", api.state_hash(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("state"))


@query("fn_similar_episodes", f"with {EP}, {Q0} select id, round(list_cosine_similarity({DBL}, q), 6) as similarity from ep join embeddings on vec_id = id, q where task = 'purchase' order by list_cosine_similarity({DBL}, q) desc, id limit 10")
def _(spark, d):
    held = episodes(spark, d).join(_emb(spark, d), F.col("id") == F.col("vec_id"))
    return api.find_similar_episodes(held, V.vector_of(_emb(spark, d), "vec_id", 0), "purchase", 10).select("id", r6("similarity").alias("similarity"))


@query("fn_search_memories", f"with {Q0} select vec_id as id, round(list_cosine_similarity({DBL}, q), 6) as similarity from embeddings, q where label = 3 and list_cosine_similarity({DBL}, q) > 0.05 order by list_cosine_similarity({DBL}, q) desc, vec_id limit 10")
def _(spark, d):
    memories = _emb(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), "embedding")
    return api.search_memories(memories, V.vector_of(_emb(spark, d), "vec_id", 0), 3, 10, 0.05).select("id", r6("similarity").alias("similarity"))


@query("fn_update_policy", f"with {EP} select session_id, task, count(*) as visits, round(avg(reward), 6) as mean from ep group by all")
def _(spark, d):
    """Means are rounded as the SQL does it: many lie right between two of the last places, where a decimal rounding goes the other way."""
    return api.update_policies(episodes(spark, d)).select("session_id", "task", "visits", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"))


@query("trg_touch", f"with {LK} select src, dst, case when weight > 4 then null else weight / 4 end as confidence, weight <= 4 as accepted from lk")
def _(spark, d):
    """Edges as the store would take them: a confidence outside 0 to 1 is refused."""
    e = links(spark, d).withColumn("confidence", F.col("weight") / 4)
    return api.checked(e, "confidence").select("src", "dst", "confidence", "accepted")


@query("tool_search_media", f"with {Q0} select vec_id as id, round(list_cosine_similarity({DBL}, q), 6) as score from embeddings join part on p_partkey = vec_id, q where p_type in ('PROMO', 'ECONOMY') and p_size >= 10 order by list_cosine_similarity({DBL}, q) desc, vec_id limit 10")
def _(spark, d):
    media = _emb(spark, d).join(table(spark, d, "part"), F.col("vec_id") == F.col("p_partkey")).select(F.col("vec_id").alias("id"), "embedding", F.array("p_type").alias("genres"), F.col("p_size").alias("rating"))
    return api.search_media(media, V.vector_of(_emb(spark, d), "vec_id", 0), 10, genres=["PROMO", "ECONOMY"], min_rating=10).select("id", r6("score").alias("score"))


@query("tool_recommendations", f"""with {RA}, u as (select item_id as id, max(rating) as rating from ra where user_id = 1 group by 1), x as (select rating, unnest({DBL}) as x, generate_subscripts(embedding, 1) as i from u join embeddings on vec_id = id), m as (select i, sum(rating * x) / sum(rating) as x from x group by 1), v as (select list(x order by i) as v from m)
    select vec_id as id, round(list_cosine_similarity({DBL}, v), 6) as score from embeddings, v where vec_id not in (select id from u) order by list_cosine_similarity({DBL}, v) desc, vec_id limit 10""")
def _(spark, d):
    """Items nearest to the rating-weighted mean of what a user had, without these."""
    own = ratings(spark, d).where("user_id = 1").groupBy(F.col("item_id").alias("id")).agg(F.max("rating").alias("rating"))
    media = _emb(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    return api.get_recommendations(media, own, 10).select("id", r6("score").alias("score"))


@query("tool_causal_chain", f"with {ED} select from_id, to_id, round(uplift, 6) as uplift from ed where uplift >= 0.5 and confidence >= 0.5")
def _(spark, d):
    return api.causal_query(causal_edges(spark, d), 0.5, 0.5).select("from_id", "to_id", r6("uplift").alias("uplift"))
