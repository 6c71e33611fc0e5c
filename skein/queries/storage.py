"""Sinks and migrations, set and sort operators, episode aggregates, audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import indexes as I
from skein.operators import ranking as R
from skein.operators import vectors as V
from skein.operators.aggregates import mean_vector
from skein.plans.ordered import running
from skein.plans.registry import query
from skein.plans.scratch import scratch_path
from skein.sources import formats
from skein.sources.sync import Cursor
from skein.sources.tables import table
from skein.sources.views import ED, EP, LK, RA, causal_edges, episodes, links, ratings

r6 = lambda c: F.round(c, 6)
DBL = "embedding::double[]"


# ---------------------------------------------------------------- sources and sinks


@query("src_npy", "select vec_id, round(list_sum(embedding::double[]), 5) as total from embeddings")
def _(spark, d):
    """Dense matrices in the .npy layout with their ids beside them, a shard per task, read back by id and never by place."""
    path = scratch_path(spark, "matrix")
    formats.npy_shards(table(spark, d, "embeddings"), "vec_id", "embedding").write.parquet(path)
    rows = formats.npy_rows(spark.read.parquet(path))
    return rows.select(F.col("id").alias("vec_id"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("src_csv_chunked", "select l_orderkey, l_linenumber::bigint as line, l_quantity from lineitem")
def _(spark, d):
    """Large CSV in many parts; reading splits them by bytes, so no chunk is held whole."""
    path = scratch_path(spark, "chunks")
    table(spark, d, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as line", "l_quantity").repartition(4).write.option("header", True).csv(path)
    return formats.read_csv(spark, path, "l_orderkey long, line long, l_quantity double")


@query("src_table_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@query("src_graph", """with e as (select 'p' || p_partkey as src, 'GENRE' as kind, p_type as dst from part union all select 'p' || p_partkey, 'BRAND', p_brand from part union all select 'p' || p_partkey, 'TAG', unnest(string_split(p_name, ' ')) from part
    union all select 's' || s_suppkey, 'CULTURE', n_name from supplier join nation on s_nationkey = n_nationkey union all select distinct 'p' || l_partkey, 'RELATION', 's' || l_suppkey from lineitem) select distinct * from e""")
def _(spark, d):
    """The scans a graph store answers by label: genres, brands, tags and cultures of nodes and relations between them, as one edge table."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    part = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"))
    found = [edge(p, part, "GENRE", F.col("p_type")), edge(p, part, "BRAND", F.col("p_brand")), edge(p, part, "TAG", F.explode(F.split("p_name", " ")))]
    found.append(edge(s, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "CULTURE", F.col("n_name")))
    found.append(edge(table(spark, d, "lineitem"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "RELATION", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


@query("sink_jsonl", f"with {EP} select id, task, round(reward, 6) as reward from ep")
def _(spark, d):
    path = scratch_path(spark, "lines")
    episodes(spark, d).select("id", "task", r6("reward").alias("reward")).write.json(path)
    return formats.read_jsonl(spark, path, "id long, task string, reward double")


@query("sink_batch_insert", "select p_partkey, p_name from part")
def _(spark, d):
    path = scratch_path(spark, "insert")
    table(spark, d, "part").select("p_partkey", "p_name").write.option("maxRecordsPerFile", 1000).parquet(path)
    return spark.read.parquet(path)


@query("sink_dual_write", "select c_custkey, 2::bigint as stores from customer")
def _(spark, d):
    main, copy = scratch_path(spark, "main"), scratch_path(spark, "copy")
    formats.write_stream_batch(table(spark, d, "customer").select("c_custkey"), main, copy)
    return spark.read.parquet(main).unionAll(spark.read.parquet(copy)).groupBy("c_custkey").agg(F.count("*").alias("stores"))


@query("sink_export", "select o_orderkey, o_orderstatus from orders")
def _(spark, d):
    path = scratch_path(spark, "export")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.option("compression", "gzip").json(path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


@query("src_migrate", "select event_id, user_id from events")
def _(spark, d):
    """Checkpointed copy between stores: a second run after the first finds nothing new and copies nothing twice."""
    from skein.streaming.events import read_events

    out, seen = scratch_path(spark, "migrated"), scratch_path(spark, "progress")
    for _ in range(2):
        read_events(spark, d).select("event_id", "user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("st_write_behind", "select event_type, count(*) as n from events group by 1")
def _(spark, d):
    """Micro-batches flushed to a table by batch id, so a batch that runs again replaces itself."""
    from skein.streaming.events import read_events

    out, seen = scratch_path(spark, "flushed"), scratch_path(spark, "progress")
    flush = lambda b, i: b.select("event_id", "event_type").write.mode("overwrite").parquet(f"{out}/batch={i}")
    read_events(spark, d).writeStream.foreachBatch(flush).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_late_data", "select date_trunc('day', ts) as start, count(*) as n from events group by 1")
def _(spark, d):
    """Daily counts under a watermark; rows of one file are never late."""
    import uuid

    from skein.streaming import events as S

    daily = S.read_events(spark, d).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    out = S.drain(daily, "skein_" + uuid.uuid4().hex, scratch_path(spark, "stream"), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("st_incremental_sync", "select event_id from events where ts > timestamp '2024-01-15'")
def _(spark, d):
    """What a second pull brings after a first one of the rows up to a day: the mark is stored between them."""
    e, cursor = table(spark, d, "events"), Cursor(spark, scratch_path(spark, "cursor"))
    cursor.pull(e.where("ts <= timestamp_ntz '2024-01-15'"), "ts", "event_id")
    return cursor.pull(e, "ts", "event_id").select("event_id")


@query("st_genre_pref", """with w as (select user_id, event_type, sum(case event_type when 'purchase' then 0.5 when 'signup' then 0.3 when 'click' then 0.1 when 'view' then 0.1 else -0.2 end) as s from events group by all)
    select user_id, event_type as genre, round(s, 6) as score from (select *, row_number() over (partition by user_id order by round(s, 6) desc, event_type) as i from w where s > 0) where i <= 10""")
def _(spark, d):
    """The ten genres of a user with the greatest positive sums of signal weights."""
    t = F.col("event_type")
    weight = F.when(t == "purchase", 0.5).when(t == "signup", 0.3).when(t.isin("click", "view"), 0.1).otherwise(-0.2)
    s = table(spark, d, "events").groupBy("user_id", t.alias("genre")).agg(F.sum(weight).alias("s")).where("s > 0").withColumn("score", r6("s"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "genre")
    return s.withColumn("i", F.row_number().over(w)).where("i <= 10").select("user_id", "genre", "score")


@query("sink_turtle", "select p_brand as s, count(*) as n from part group by 1")
def _(spark, d):
    """Triples as Turtle text per subject; the count is of predicate-object pairs in the text."""
    t = table(spark, d, "part").selectExpr("p_brand as s", "concat('has', p_partkey) as p", "p_name as o")
    return formats.to_turtle(t).select("s", (F.size(F.split("turtle", " ; "))).cast("long").alias("n"))


# ---------------------------------------------------------------- filters, joins, sets, sorts


@query("flt_api", "select p_partkey from part where p_type in ('STANDARD', 'PROMO') and p_retailprice >= 950 and p_size between 5 and 40")
def _(spark, d):
    return table(spark, d, "part").where("p_type in ('STANDARD', 'PROMO') and p_retailprice >= 950 and p_size between 5 and 40").select("p_partkey")


@query("flt_correlated_not_exists", f"with {EP} select id from ep a where not exists (select 1 from labels where doc_id = a.id)")
def _(spark, d):
    lab = table(spark, d, "labels")
    return episodes(spark, d).join(lab, F.col("id") == F.col("doc_id"), "left_anti").select("id")


@query("join_pattern_embed", "select p_partkey, label::bigint as label from part join embeddings on vec_id = p_partkey where p_size > 10")
def _(spark, d):
    return table(spark, d, "part").where("p_size > 10").join(table(spark, d, "embeddings"), F.col("p_partkey") == F.col("vec_id")).select("p_partkey", F.col("label").cast("long").alias("label"))


@query("join_hydrate", f"with t as (select vec_id, row_number() over (order by list_cosine_similarity({DBL}, (select {DBL} from embeddings where vec_id = 0)) desc, vec_id) as rank from embeddings where vec_id <> 0) select rank::bigint as rank, p_partkey, p_name from t join part on p_partkey = vec_id where rank <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    top = V.knn(e, V.vector_of(e, "vec_id", 0), "vec_id", "embedding", 10, exclude=0)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long"))
    return F.broadcast(ranked).join(table(spark, d, "part"), F.col("vec_id") == F.col("p_partkey")).select("rank", "p_partkey", "p_name")


@query("join_cert_just", "select o_orderkey, count(l_linenumber) as n, max(l_quantity) as most from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def _(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"), F.max("l_quantity").alias("most"))


@query("join_media_ontology", "select p_partkey, coalesce(s, '') as suppliers from part left join (select l_partkey, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as s from lineitem group by 1) on l_partkey = p_partkey")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("s"))
    return table(spark, d, "part").join(s, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("s", F.lit("")).alias("suppliers"))


@query("set_merge_shards", "select vec_id % 4 as shard, count(*) as n from embeddings group by 1")
def _(spark, d):
    from functools import reduce

    e = table(spark, d, "embeddings")
    shards = [e.where(F.col("vec_id") % 4 == i).select("vec_id", F.lit(i).cast("long").alias("shard")) for i in range(4)]
    return reduce(lambda a, b: a.unionByName(b), shards).groupBy("shard").agg(F.count("*").alias("n"))


@query("sort_multi", f"with {ED} select from_id, to_id from ed order by abs(uplift) * confidence desc, from_id limit 20")
def _(spark, d):
    return causal_edges(spark, d).orderBy(F.desc(F.abs("uplift") * F.col("confidence")), "from_id").limit(20).select("from_id", "to_id")


@query("sort_severity", "select o_orderpriority as severity, count(*) as n from orders group by 1 order by 1 limit 3")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n")).orderBy("severity").limit(3)


@query("sort_pairs", f"with {LK} select src, dst from lk")
def _(spark, d):
    """Pairs laid out for locality: ranges of sources, sorted within each."""
    return links(spark, d).select("src", "dst").repartitionByRange("src").sortWithinPartitions("src", "dst")


@query("win_rank_assign", f"with {EP} select id, row_number() over (partition by task order by reward desc, id)::bigint as rank from ep")
def _(spark, d):
    """Ranks come from ranges of a task's rows, so a task with most of them is no single partition."""
    return running(episodes(spark, d).select("id", "task", "reward"), ["task"], [F.desc("reward"), F.asc("id")], "rank").select("id", "rank")


@query("win_event_order", f"with {EP} select session_id, id, row_number() over (partition by session_id order by ts, id)::bigint as step from ep")
def _(spark, d):
    return episodes(spark, d).select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id")).cast("long").alias("step"))


# ---------------------------------------------------------------- aggregates


@query("agg_learning_overall", f"with {EP} select count(*) as n, round(avg(reward), 6) as mean, round(min(reward), 6) as low, round(max(reward), 6) as high, round(avg(latency), 6) as latency from ep")
def _(spark, d):
    return episodes(spark, d).agg(F.count("*").alias("n"), r6(F.avg("reward")).alias("mean"), r6(F.min("reward")).alias("low"), r6(F.max("reward")).alias("high"), r6(F.avg("latency")).alias("latency"))


@query("agg_outcome_model", f"with {EP}, x as (select distinct session_id from ep where task = 'purchase') select round(coalesce(nullif(avg(reward) filter (session_id in (select * from x)), 0), 0.5), 6) as exposed, round(coalesce(nullif(avg(reward) filter (session_id not in (select * from x)), 0), 0.5), 6) as others from ep")
def _(spark, d):
    e = episodes(spark, d)
    hit = e.where("task = 'purchase'").select("session_id").distinct().withColumn("hit", F.lit(True))
    j = e.join(hit, "session_id", "left")
    mean = lambda c: r6(F.coalesce(F.nullif(F.avg(F.when(c, F.col("reward"))), F.lit(0.0)), F.lit(0.5)))
    return j.agg(mean(F.col("hit").isNotNull()).alias("exposed"), mean(F.col("hit").isNull()).alias("others"))


@query("agg_mean_vector", f"with {RA}, u as (select distinct user_id, item_id % (select count(*) from embeddings) as v from ra), x as (select user_id, unnest({DBL}) as x, generate_subscripts(embedding, 1) as pos from u join embeddings on vec_id = v), m as (select user_id, pos, avg(x) as x from x group by all) select user_id, round(sqrt(sum(x * x)), 5) as norm from m group by 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    u = ratings(spark, d).select("user_id", (F.col("item_id") % e.count()).alias("vec_id")).distinct()
    return mean_vector(u.join(e, "vec_id"), "user_id", "embedding", dims=V.dims_of(e)).select("user_id", F.round(V.norm("vector"), 5).alias("norm"))


@query("agg_federated", f"""with a as (select label, vec_id, embedding, 0.5 + vec_id % 50 / 100 as q from embeddings), k as (select *, row_number() over (partition by label order by vec_id desc) as i from a where q >= 0.7), x as (select label, q, unnest({DBL}) as x, generate_subscripts(embedding, 1) as pos from k where i <= 100),
    m as (select label, pos, sum(q * x) / sum(q) as x from x group by all) select label::bigint as label, round(sqrt(sum(x * x)), 5) as norm from m group by 1""")
def _(spark, d):
    """Quality-weighted mean of the 100 newest agent vectors of quality 0.7 and more."""
    a = table(spark, d, "embeddings").withColumn("q", 0.5 + F.col("vec_id") % 50 / 100).where("q >= 0.7")
    newest = a.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))).where("i <= 100")
    return mean_vector(newest, "label", "embedding", F.col("q")).select(F.col("label").cast("long").alias("label"), F.round(V.norm("vector"), 5).alias("norm"))


@query("agg_quality_cert", "select l_orderkey as cert, count(*) as n, round(avg(l_discount), 6) as necessity from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cert")).agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("necessity"))


@query("agg_reconcile_l2", f"with x as (select list_distance({DBL}, list_transform({DBL}, lambda x: case when vec_id % 10 = 0 then x + 0.001 else x end)) as gap from embeddings) select round(max(gap), 6) as worst, round(avg(gap), 6) as mean, round(avg((gap <= 1e-5)::int), 6) as matched from x")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = e.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("a", lambda x: x + 0.001)).otherwise(F.col("a")).alias("b"))
    g = e.join(other, "vec_id").select(V.l2("a", "b").alias("gap"))
    return g.agg(r6(F.max("gap")).alias("worst"), r6(F.avg("gap")).alias("mean"), r6(F.avg((F.col("gap") <= 1e-5).cast("int"))).alias("matched"))


@query("agg_synthesis", f"""with {EP}, a as (select task, avg(success::int) as s, avg(reward) as r, count(*) filter (reward >= 0.9) as exemplars, count(*) as n from ep group by 1)
    select task, round(s, 6) as success, round(r, 6) as reward, exemplars, array_to_string(list_filter([case when s >= 0.8 then 'high success' when s < 0.5 then 'low success' end, case when r >= 0.8 then 'high reward' end, case when n >= 10 then 'well supported' end], lambda x: x is not null), ';') as insights from a""")
def _(spark, d):
    a = episodes(spark, d).groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("s"), F.avg("reward").alias("r"), F.count_if(F.col("reward") >= 0.9).alias("exemplars"), F.count("*").alias("n"))
    notes = F.array(F.when(F.col("s") >= 0.8, "high success").when(F.col("s") < 0.5, "low success"), F.when(F.col("r") >= 0.8, "high reward"), F.when(F.col("n") >= 10, "well supported"))
    return a.select("task", r6("s").alias("success"), r6("r").alias("reward"), "exemplars", F.array_join(F.array_compact(notes), ";").alias("insights"))


@query("agg_cache_hit", "select round(avg((n > 1)::int), 6) as rate, sum(n)::bigint as total from (select user_id, event_type, count(*) as n from events group by all)")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.agg(r6(F.avg((F.col("n") > 1).cast("int"))).alias("rate"), F.sum("n").alias("total"))


@query("agg_distinct", "select count(distinct o_custkey) as buyers, count(distinct o_orderpriority) as priorities from orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("buyers"), F.countDistinct("o_orderpriority").alias("priorities"))


# ---------------------------------------------------------------- supplements


@query("sup_top_reasons", "select l_orderkey, string_agg(l_suppkey::varchar, ',' order by l_quantity desc, l_linenumber, l_suppkey) as reasons from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_suppkey) as i from lineitem) where i <= 3 group by 1")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_suppkey")
    top = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w)).where("i <= 3")
    names = F.transform(F.array_sort(F.collect_list(F.struct("i", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    return top.groupBy("l_orderkey").agg(F.array_join(names, ",").alias("reasons"))


@query("sup_axiom_parse", "with a as (select n_name as s, r_name as o from nation join region on n_regionkey = r_regionkey), e as (select s as x from a union select o from a), i as (select x, dense_rank() over (order by x)::bigint as id from e) select s.id as s, 'subclassof' as kind, o.id as o, 0.5 as weight from a join i s on s.x = a.s join i o on o.x = a.o")
def _(spark, d):
    """Axiom lines ``subject predicate object type weight`` to numbered entities; numbers are ranks in the vocabulary of classes."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    lines = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("\t", "n_name", F.lit("is"), "r_name", F.lit("SubClassOf"), F.lit("0.5")).alias("line"))
    cell = F.split("line", "\t")
    a = lines.select(cell[0].alias("s"), cell[2].alias("o"), F.lower(cell[3]).alias("kind"), F.coalesce(F.try_element_at(cell, F.lit(5)).cast("double"), F.lit(1.0)).alias("weight"))
    ids = a.select(F.col("s").alias("x")).union(a.select("o")).distinct().withColumn("id", F.dense_rank().over(Window.orderBy("x")).cast("long"))
    return a.join(ids.select(F.col("x").alias("s"), F.col("id").alias("si")), "s").join(ids.select(F.col("x").alias("o"), F.col("id").alias("oi")), "o").select(F.col("si").alias("s"), "kind", F.col("oi").alias("o"), "weight")


@query("sup_audit_query", "select event_id, case event_type when 'error' then 'critical' when 'purchase' then 'high' else 'low' end as severity from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type in ('purchase', 'click', 'error')")
def _(spark, d):
    """A log of JSON lines, written and read back, filtered by date, type and severity."""
    path = scratch_path(spark, "audit")
    t = F.col("event_type")
    severity = F.when(t == "error", "critical").when(t == "purchase", "high").otherwise("low")
    entry = F.struct(F.col("event_id").alias("id"), F.col("ts").cast("string").alias("timestamp"), t.alias("type"), F.col("user_id").alias("userId"))
    table(spark, d, "events").select(entry.alias("event"), severity.alias("severity")).write.json(path)
    log = formats.read_jsonl(spark, path, "event struct<id:long,timestamp:string,type:string,userId:long>, severity string")
    at = F.col("event.timestamp").cast("timestamp_ntz")
    kept = log.where((at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at < F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("event.type").isin("purchase", "click", "error"))
    return kept.select(F.col("event.id").alias("event_id"), "severity")


@query("sup_gpu_constraints", "select 'quantity' as rule, count(*) as n from lineitem where l_quantity <= 0 union all select 'order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'price', count(*) from part where p_retailprice < 1000")
def _(spark, d):
    lines, n = table(spark, d, "lineitem"), F.count("*").alias("n")
    out = lines.where("l_quantity <= 0").select(F.lit("quantity").alias("rule")).agg(F.lit("quantity").alias("rule"), n)
    out = out.union(lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("order").alias("rule"), n))
    return out.union(table(spark, d, "part").where("p_retailprice < 1000").agg(F.lit("price").alias("rule"), n))


@query("sup_preflight", "select 'documents' as item, (count(*) > 0 and count(*) = count(doc_id))::bigint as passed from documents union all select 'embeddings', (min(len(embedding)) = max(len(embedding)))::bigint from embeddings")
def _(spark, d):
    docs = table(spark, d, "documents").agg(F.lit("documents").alias("item"), ((F.count("*") > 0) & (F.count("*") == F.count("doc_id"))).cast("long").alias("passed"))
    return docs.union(table(spark, d, "embeddings").agg(F.lit("embeddings").alias("item"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).cast("long").alias("passed")))


@query("sup_recommend_action", f"with {EP}, p as (select sha256(session_id::varchar) as state, arg_max(task, (reward, id)) as action from ep group by 1) select session_id, action from (select distinct session_id from ep) join p on state = sha256(session_id::varchar)")
def _(spark, d):
    e = episodes(spark, d).withColumn("state", F.sha2(F.col("session_id").cast("string").cast("binary"), 256))
    policy = e.groupBy("state").agg(F.max_by("task", F.struct("reward", "id")).alias("action"))
    return e.select("session_id", "state").distinct().join(policy, "state").select("session_id", "action")


@query("ann_hybrid_mode", f"with p as (select a.vec_id as query, b.vec_id as id, list_cosine_similarity(a.{DBL}, b.{DBL}) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) select query, id, round(score, 6) as score, rank::bigint as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from p) where rank <= 10")
def _(spark, d):
    """The plan for a batch search by size and recall target; at a target of 0.99 it is exact at every size."""
    e = table(spark, d, "embeddings")
    found = I.search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64, 10, 0.99)
    return found.select("query", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ann_pq_encode")
def _(spark, d):
    """Codes of every vector from codebooks trained on a bounded sample."""
    e = table(spark, d, "embeddings")
    pq = I.ProductQuantizer().fit(e, "vec_id", "embedding")
    return pq.encode(e, "vec_id", "embedding")


@query("vec_pca")
def _(spark, d):
    """Two principal coordinates, signs fixed; the covariance is summed over partitions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    y = PCA(k=2, inputCol="x", outputCol="y").fit(x).transform(x).select("vec_id", vector_to_array("y").alias("y"))
    return y.select("vec_id", r6(F.abs(F.col("y")[0])).alias("first"), r6(F.abs(F.col("y")[1])).alias("second"))
