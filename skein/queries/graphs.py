"""Graphs, ontology reasoning, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import ontology as O
from skein.operators.components import connected_components
from skein.operators.provenance import merkle_roots
from skein.operators.ranking import skyline
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import ED, EP, LK, causal_edges, episodes, links

r6 = lambda c: F.round(c, 6)
#: A class hierarchy over the whole part table: each part lies under the part of half its number.
TREE = "tr as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey >= 2)"


def tree(spark, d):
    return table(spark, d, "part").where("p_partkey >= 2").selectExpr("p_partkey as src", "p_partkey div 2 as dst")


def classes(spark, d):
    """Every class as its own ancestor."""
    return table(spark, d, "part").where("p_partkey >= 1").selectExpr("p_partkey as src", "p_partkey as dst")


@query("g_causal_chain", f"""with recursive {ED}, w as (select from_id as start, to_id as node, uplift, confidence as low, [from_id, to_id] as path from ed
    union all select start, to_id, w.uplift + ed.uplift, least(low, confidence), list_append(path, to_id) from w join ed on node = from_id where len(path) <= 5 and not list_contains(path, to_id))
    select start, node, len(path) - 1 as hops, round(uplift, 6) as uplift, round(low, 6) as low from w""")
def _(spark, d):
    e = causal_edges(spark, d)
    step = e.select(F.col("from_id").alias("start"), F.col("to_id").alias("node"), F.col("uplift").alias("u"), F.col("confidence").alias("low"), F.array("from_id", "to_id").alias("path"))
    out = step
    for _ in range(4):
        step = step.join(e, F.col("node") == F.col("from_id")).where(~F.array_contains(F.col("path"), F.col("to_id")))
        step = step.select("start", F.col("to_id").alias("node"), (F.col("u") + F.col("uplift")).alias("u"), F.least("low", "confidence").alias("low"), F.concat("path", F.array("to_id")).alias("path"))
        out = out.unionByName(step)
    return out.select("start", "node", (F.size("path") - 1).cast("long").alias("hops"), r6("u").alias("uplift"), r6("low").alias("low"))


PATHS = """p as (select src as start, dst as node, 1 as hops, weight as cost, [src, dst] as path from lk where src in (1, 2, 5)
    union all select start, dst, hops + 1, cost + weight, list_append(path, dst) from p join lk on node = src where hops < 4 and not list_contains(path, dst))"""


def _paths(spark, d):
    return G.paths(links(spark, d), spark.createDataFrame([(1,), (2,), (5,)], "n long"), 4)


@query("g_bfs_paths", f"with recursive {LK}, {PATHS} select start, node, hops::bigint as hops, round(cost, 6) as cost, array_to_string(path, '>') as path from p")
def _(spark, d):
    return _paths(spark, d).select("start", "node", F.col("hops").cast("long").alias("hops"), r6("cost").alias("cost"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g_k_shortest", f"with recursive {LK}, {PATHS}, k as (select start, node, cost, row_number() over (partition by start, node order by cost, array_to_string(path, '>')) as rank from p) select start, node, rank, round(cost, 6) as cost from k where rank <= 2")
def _(spark, d):
    from pyspark.sql.window import Window

    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    p = _paths(spark, d).withColumn("p", text)
    w = Window.partitionBy("start", "node").orderBy("cost", "p")
    return p.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("start", "node", "rank", r6("cost").alias("cost"))


@query("g_graph_similar", f"with recursive {LK}, {PATHS} select start, node, round(sum(1.0 / hops), 6) as score from p group by all")
def _(spark, d):
    return _paths(spark, d).groupBy("start", "node").agg(r6(F.sum(1.0 / F.col("hops"))).alias("score"))


@query("g_filter_paths", f"with recursive {LK}, {PATHS} select start, node, round(max(1 / hops / (1 + cost)), 6) as score from p where cost < 20 group by all")
def _(spark, d):
    return _paths(spark, d).where("cost < 20").groupBy("start", "node").agg(r6(F.max(1 / F.col("hops") / (1 + F.col("cost")))).alias("score"))


@query("g_sssp", f"with recursive {LK}, s as (select 1::bigint as node, 0.0::double as dist, 0 as hops union select dst, dist + weight, hops + 1 from s join lk on node = src where hops < 12 and dist + weight <= 12) select node, round(min(dist), 6) as dist from s group by 1")
def _(spark, d):
    found = G.shortest(links(spark, d), spark.createDataFrame([(1,)], "n long"), bound=12.0)
    return found.select("node", r6("dist").alias("dist"))


@query("g_degree", f"with {LK} select node, count(*) as degree from (select src as node from lk union all select dst from lk) group by 1")
def _(spark, d):
    e = links(spark, d)
    return e.select(F.col("src").alias("node")).unionAll(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


@query("g_components", f"with recursive {LK}, b as (select src, dst from lk union select dst, src from lk), r as (select src as node, src as c from b union select b.dst, r.c from r join b on b.src = r.node) select node, min(c) as component from r group by 1")
def _(spark, d):
    return connected_components(links(spark, d))


_VOTES = "".join(f", l{i + 1} as (select node, arg_max(label, (n, -label)) as label from (select b.src as node, l.label, count(*) as n from b join l{i} l on b.dst = l.node group by all) group by 1)" for i in range(5))


@query("g_label_propagation", f"with {LK}, b as (select src, dst from lk union select dst, src from lk), l0 as (select distinct src as node, src as label from b){_VOTES} select * from l5")
def _(spark, d):
    """Labels after five synchronous rounds; five is the definition, settled or not."""
    return G.label_propagation(links(spark, d))


@query("g_modularity", f"with {LK}, e as (select src % 4 as a, dst % 4 as b from lk), k as (select l, count(*) as k from (select a as l from e union all select b from e) group by 1), i as (select a as l, sum((a = b)::int) as i from e group by 1) select round(sum(coalesce(i, 0) / (select count(*) from e) - power(k / (2.0 * (select count(*) from e)), 2)), 6) as q from k left join i using (l)")
def _(spark, d):
    e = links(spark, d)
    labels = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("label", F.col("node") % 4)
    return G.modularity(e, labels).select(r6("q").alias("q"))


@query("g_landmarks", f"with {LK}, g as (select src as node, count(*) as k from lk group by 1) select node from g order by k desc, node limit 5")
def _(spark, d):
    return links(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "node").limit(5).select("node")


@query("g_hyper_pattern", "select l_orderkey, count(*) as size from lineitem group by 1 having count(*) >= 3")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).where("size >= 3")


@query("g_pareto", f"with {EP}, m as (select session_id as id, avg(reward) as r, avg(latency) as l from ep group by 1) select id from m a where not exists (select 1 from m b where b.r >= a.r and b.l <= a.l and (b.r > a.r or b.l < a.l))")
def _(spark, d):
    """Rewards are added as decimals, so that sessions of the same rewards tie in whatever order tasks add them."""
    total = F.sum(F.col("reward").cast("decimal(28,18)")).cast("double")
    m = episodes(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.try_divide(total, F.count("reward")).alias("r"), F.avg("latency").alias("l"))
    return skyline(m, "r", "l").select("id")


@query("o_closure", f"with recursive {TREE}, c as (select src, dst from tr union select c.src, tr.dst from c join tr on c.dst = tr.src) select src, dst from c except select src, dst from tr")
def _(spark, d):
    e = tree(spark, d)
    return G.closure(e).join(e, ["src", "dst"], "left_anti")


@query("o_is_subgenre", f"with recursive {TREE}, c as (select src, dst from tr union select c.src, tr.dst from c join tr on c.dst = tr.src) select src from c where dst = 5")
def _(spark, d):
    return G.closure(tree(spark, d)).where("dst = 5").select("src")


@query("o_cycles", f"with recursive {LK}, c as (select src, dst from lk union select c.src, lk.dst from c join lk on c.dst = lk.src), m as (select a.src as node, least(min(a.dst), a.src) as component from c a join c b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src) select component, node from m")
def _(spark, d):
    """Cycles of the part graph."""
    return G.strong_components(links(spark, d))


@query("o_disjoint_violation", f"with recursive {TREE}, c as (select src, dst from tr union select c.src, tr.dst from c join tr on c.dst = tr.src), u as (select * from c union select p_partkey, p_partkey from part where p_partkey >= 1), g as (select p_partkey as e, 1 + p_size % 63 as t from part union select p_partkey, 1 + p_partkey % 63 from part) select e from g join u on t = src where dst in (4, 5, 6) group by 1 having count(distinct dst) > 1")
def _(spark, d):
    up = G.closure(tree(spark, d)).unionByName(classes(spark, d)).where("dst in (4, 5, 6)")
    p = table(spark, d, "part")
    g = p.selectExpr("p_partkey as e", "cast(1 + p_size % 63 as bigint) as src").union(p.selectExpr("p_partkey", "1 + p_partkey % 63"))
    return g.join(up, "src").groupBy("e").agg(F.countDistinct("dst").alias("n")).where("n > 1").select("e")


@query("o_paradox", """with t as (select doc_id, text from documents), g as (select * from (values (1, ['FamilyFriendly', 'Children'], ['Rated-R', 'Mature', 'Adult']), (2, ['Educational'], ['Exploitation', 'Gratuitous']), (3, ['Peaceful', 'Calm'], ['Action', 'Horror', 'Thriller'])) v(rule, yes, no)),
    m as (select p_partkey, [case p_size % 6 when 0 then 'Children' when 1 then 'Mature' when 2 then 'Educational' when 3 then 'Peaceful' when 4 then 'Action' else 'Gratuitous' end, case p_partkey % 5 when 0 then 'Adult' when 1 then 'Calm' when 2 then 'Horror' when 3 then 'FamilyFriendly' else 'Exploitation' end, p_type] as tags from part)
    select p_partkey, rule::bigint as rule from m, g where len(list_filter(tags, lambda x: len(list_filter(yes, lambda y: contains(x, y))) > 0)) > 0 and len(list_filter(tags, lambda x: len(list_filter(no, lambda y: contains(x, y))) > 0)) > 0""")
def _(spark, d):
    """Media whose tags hold both sides of a rule."""
    a = F.col("p_size") % 6
    first = F.when(a == 0, "Children").when(a == 1, "Mature").when(a == 2, "Educational").when(a == 3, "Peaceful").when(a == 4, "Action").otherwise("Gratuitous")
    b = F.col("p_partkey") % 5
    other = F.when(b == 0, "Adult").when(b == 1, "Calm").when(b == 2, "Horror").when(b == 3, "FamilyFriendly").otherwise("Exploitation")
    m = table(spark, d, "part").select("p_partkey", F.array(first, other, F.col("p_type")).alias("tags"))
    return m.select("p_partkey", F.explode(O.paradoxes(F.col("tags"))).alias("rule")).select("p_partkey", F.col("rule").cast("long").alias("rule"))


@query("o_val_refs", "select l_orderkey, l_linenumber::bigint as line from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def _(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as line")


@query("o_val_functional", "select l_partkey as s, count(distinct l_suppkey) as n from lineitem group by 1 having count(distinct l_suppkey) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("s")).agg(F.countDistinct("l_suppkey").alias("n")).where("n > 1")


@query("o_classify_path", "select page_id, case when regexp_matches(url, '/en/') then 'English' when regexp_matches(url, '/fr/') then 'French' when regexp_matches(url, '/de/') then 'German' else 'Other' end as class from pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.rlike("/en/"), "English").when(u.rlike("/fr/"), "French").when(u.rlike("/de/"), "German").otherwise("Other").alias("class"))


#: Fourteen levels cover groups of up to 16,384 chunks.
MERKLE = "l0 as (select c_nationkey as g, sha256(c_name) as h, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i from customer)" + "".join(
    f", l{n + 1} as (select g, i // 2 as i, case when count(*) = 2 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from l{n} group by g, i // 2)" for n in range(14)
)


@query("p_merkle", f"with {MERKLE} select g::bigint as g, h as root from l14")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) as g", "c_custkey as pos", "sha2(cast(c_name as binary), 256) as h")
    return merkle_roots(c, "g", "pos", "h")


@query("p_completeness", "select l_orderkey, round(count(distinct case when l_quantity >= 25 then l_partkey % 5 end) / count(distinct l_partkey % 5), 6) as completeness from lineitem group by 1")
def _(spark, d):
    """Of an order's requirements (kinds of parts), the share that a line of 25 or more meets."""
    kind = F.col("l_partkey") % 5
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.countDistinct(F.when(F.col("l_quantity") >= 25, kind)) / F.countDistinct(kind)).alias("completeness"))


@query("g_lineage", f"with recursive {TREE}, l as (select p_partkey as start, p_partkey as node, 0 as depth from part where p_partkey % 50 = 1 union all select start, dst, depth + 1 from l join tr on node = src) select start, node, depth::bigint as depth from l")
def _(spark, d):
    """The line of sources of each record of the query set, up to its root; a round climbs a step for all of them."""
    return G.lineage(tree(spark, d), table(spark, d, "part").where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("start")))
