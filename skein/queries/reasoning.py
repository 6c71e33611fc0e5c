"""Ontology rules, layout forces, distances over landmarks, hypergraphs and certificates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import graph as G
from skein.operators import ontology as O
from skein.operators.pairs import pairs_within
from skein.operators.provenance import merkle_proofs
from skein.plans.registry import query
from skein.queries.graphs import MERKLE, TREE, classes, tree
from skein.sources.tables import table
from skein.sources.views import ED, EP, LK, causal_edges, episodes, links

r6 = lambda c: F.round(c, 6)
UP = f"{TREE}, c as (select src, dst from tr union select c.src, tr.dst from c join tr on c.dst = tr.src), u as (select * from c union select p_partkey, p_partkey from part where p_partkey >= 1)"
#: Siblings far down the hierarchy are stated to be disjoint, so what lies under them is a fixed number of classes.
DISJOINT = "n as (select count(*) // 32 as n from part), d as (select p_partkey as a, p_partkey + 1 as b from part, n where p_partkey % 2 = 0 and p_partkey between n and n + 20)"


def _disjoint(spark, d):
    p = table(spark, d, "part")
    n = p.count() // 32
    return p.where((F.col("p_partkey") % 2 == 0) & F.col("p_partkey").between(n, n + 20)).selectExpr("p_partkey as a", "p_partkey + 1 as b")


@query("o_disjoint_inherit", f"with recursive {UP}, {DISJOINT} select distinct least(x.src, y.src)::bigint as a, greatest(x.src, y.src)::bigint as b from d join u x on x.dst = a join u y on y.dst = b")
def _(spark, d):
    return O.inherit_disjoint(tree(spark, d), _disjoint(spark, d))


@query("o_el_subsumption", f"with recursive {UP} select src::bigint as sub, dst::bigint as super, (src = dst)::bigint as reflexive from u")
def _(spark, d):
    return G.closure(tree(spark, d)).unionByName(classes(spark, d)).select(F.col("src").alias("sub"), F.col("dst").alias("super"), (F.col("src") == F.col("dst")).cast("long").alias("reflexive"))


@query("o_val_disjoint", f"with recursive e as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey >= 2 union select p_partkey, p_partkey // 2 + 1 from part where p_partkey % 11 = 0 and p_partkey >= 3), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), u as (select * from c union select p_partkey, p_partkey from part), {DISJOINT} select distinct x.src as node from d join u x on x.dst = a join u y on y.dst = b and y.src = x.src")
def _(spark, d):
    """Classes under both sides of a disjoint pair, where every eleventh class has a second parent."""
    more = table(spark, d, "part").where("p_partkey % 11 = 0 and p_partkey >= 3").selectExpr("p_partkey as src", "p_partkey div 2 + 1 as dst")
    return O.unsatisfiable(tree(spark, d).union(more), _disjoint(spark, d))


@query("o_val_labels", "select documents.doc_id from documents left join (select doc_id from labels where trim(coalesce(quality::varchar, '')) <> '') l on documents.doc_id = l.doc_id where l.doc_id is null")
def _(spark, d):
    """Entities without a label that is more than blanks."""
    named = table(spark, d, "labels").where("trim(coalesce(cast(quality as string), '')) <> ''").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(named, "doc_id", "left_anti")


@query("o_val_domain_range", """with t as (select 'o' || l_orderkey as s, case when l_returnflag = 'R' then 'returned' else 'sold' end as p, 's' || l_suppkey as o from lineitem),
    k as (select 'o' || o_orderkey as node, 'order' as class from orders where o_orderstatus <> 'P' union all select 's' || s_suppkey, 'supplier' from supplier where s_acctbal > 0)
    select s, p, o, 'domain' as rule from t where p = 'returned' and s not in (select node from k where class = 'order') union all select s, p, o, 'range' from t where p = 'returned' and o not in (select node from k where class = 'supplier')""")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey) as s", "if(l_returnflag = 'R', 'returned', 'sold') as p", "concat('s', l_suppkey) as o")
    k = table(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("concat('o', o_orderkey) as node", "'order' as class")
    k = k.union(table(spark, d, "supplier").where("s_acctbal > 0").selectExpr("concat('s', s_suppkey)", "'supplier'"))
    return O.domain_range(t, k, spark.createDataFrame([("returned", "order", "supplier")], "p string, domain string, range string"))


@query("agg_rdf_conflict", """with t as (select distinct l_partkey as s, 'supplier' as p, l_suppkey as o, max(l_quantity / 50) as c from lineitem group by all), b as (select s, p, arg_max(o, (c, o)) as best from t group by all)
    select s, case when o = best then p else p || ':alternative' end as p, o, round(c, 6) as confidence from t join b using (s, p) where o = best or c >= 0.6""")
def _(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("s"), F.lit("supplier").alias("p"), F.col("l_suppkey").alias("o")).agg(F.max(F.col("l_quantity") / 50).alias("confidence"))
    return O.conflicts(t, 0.6).withColumn("confidence", r6("confidence"))


MOODS = "m as (select p_type as mood, avg(p_size / 50) as v, avg(p_retailprice % 100 / 100) as a, avg(p_partkey % 10 / 10) as e from part group by 1)"


def _moods(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("mood")).agg(F.avg(F.col("p_size") / 50).alias("v"), F.avg(F.col("p_retailprice") % 100 / 100).alias("a"), F.avg(F.col("p_partkey") % 10 / 10).alias("e"))


@query("o_mood_similar", f"with {MOODS} select x.mood as a, y.mood as b, round(1 - sqrt((power(x.v - y.v, 2) + power(x.a - y.a, 2) + power(x.e - y.e, 2)) / 3), 6) as similarity from m x join m y on x.mood < y.mood where 1 - sqrt((power(x.v - y.v, 2) + power(x.a - y.a, 2) + power(x.e - y.e, 2)) / 3) > 0.7")
def _(spark, d):
    """Similar moods. Moods are a small vocabulary (one row a type), so their pairs are few whatever the table's size."""
    m = _moods(spark, d)
    other = m.select(*[F.col(c).alias(f"{c}2") for c in m.columns])
    gap = sum((F.pow(F.col(c) - F.col(f"{c}2"), F.lit(2)) for c in "vae"), F.lit(0.0))
    return m.join(other, F.col("mood") < F.col("mood2")).withColumn("s", 1 - F.sqrt(gap / 3)).where("s > 0.7").select(F.col("mood").alias("a"), F.col("mood2").alias("b"), r6("s").alias("similarity"))


@query("o_infer_mood", "select p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_type, ' '), lambda g: case g when 'STANDARD' then 'calm' when 'SMALL' then 'calm' else 'lively' end))), ',') as moods from part")
def _(spark, d):
    mood = F.transform(F.split("p_type", " "), lambda g: F.when(g.isin("STANDARD", "SMALL"), "calm").otherwise("lively"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(mood)), ",").alias("moods"))


@query("o_map_genome", "select l_partkey as item, string_agg(distinct s_nationkey::varchar, ',' order by s_nationkey::varchar) as classes from lineitem join supplier on l_suppkey = s_suppkey where l_quantity / 50 > 0.7 group by 1")
def _(spark, d):
    """Classes of an item's tags with relevance over 0.7."""
    tags = table(spark, d, "lineitem").where("l_quantity / 50 > 0.7").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return tags.groupBy(F.col("l_partkey").alias("item")).agg(F.array_join(F.array_sort(F.collect_set(F.col("s_nationkey").cast("string"))), ",").alias("classes"))


FORCE = f"""{LK}, n as (select p_partkey as node, (p_partkey * 37 % 101) / 10.0 as x, (p_partkey * 53 % 103) / 10.0 as y, (p_partkey * 71 % 107) / 10.0 as z, 1 + p_size / 50.0 as mass, p_size / 25.0 as r from part),
    j as (select src, dst, weight as rest, a.mass as ma, b.mass as mb, a.r as ra, b.r as rb, b.x - a.x as x, b.y - a.y as y, b.z - a.z as z, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2)) as dist from lk join n a on src = a.node join n b on dst = b.node),
    f as (select *, greatest(-10, least(10, MAG)) / dist as k from j where dist > 1e-6)
    select node, round(sum(fx), 5) as fx, round(sum(fy), 5) as fy, round(sum(fz), 5) as fz from (select src as node, k * x / ma as fx, k * y / ma as fy, k * z / ma as fz from f union all select dst, -k * x / mb, -k * y / mb, -k * z / mb from f) group by 1"""


def _forces(spark, d, magnitude):
    n = table(spark, d, "part").selectExpr("p_partkey as node", "(p_partkey * 37 % 101) / 10 as x", "(p_partkey * 53 % 103) / 10 as y", "(p_partkey * 71 % 107) / 10 as z", "1 + p_size / 50 as mass", "p_size / 25 as radius")
    pairs = links(spark, d).select("src", "dst", F.col("weight").alias("rest"), F.lit(0.5).alias("strength"))
    return O.forces(n, pairs, magnitude).select("node", *[F.round(c, 5).alias(c) for c in ("fx", "fy", "fz")])


@query("o_forces", "with " + FORCE.replace("MAG", "case when dist < ra + rb + rest then -0.5 * (ra + rb + rest - dist) / (ra + rb + rest) else 0 end"))
def _(spark, d):
    return _forces(spark, d, O.hold_apart())


@query("o_layout_forces", "with " + FORCE.replace("MAG", "0.5 * (dist - rest)"))
def _(spark, d):
    return _forces(spark, d, O.spring())


# ---------------------------------------------------------------- graphs


@query("g_direct_path", f"with {LK} select src, dst, round(1 / (1 + weight), 6) as score from lk where weight <= 3")
def _(spark, d):
    return links(spark, d).where("weight <= 3").select("src", "dst", r6(1 / (1 + F.col("weight"))).alias("score"))


@query("g_hierarchical", f"with recursive {UP} select x.src::bigint as a, y.src::bigint as b, max(x.dst)::bigint as ancestor from u x join u y on x.dst = y.dst and y.src = x.src + 1 group by all")
def _(spark, d):
    """The nearest common ancestor of each class and the next: in this tree the greatest number."""
    up = G.closure(tree(spark, d)).unionByName(classes(spark, d))
    other = up.select(F.col("src").alias("b"), F.col("dst").alias("above"))
    j = up.join(other, (F.col("dst") == F.col("above")) & (F.col("b") == F.col("src") + 1))
    return j.groupBy(F.col("src").alias("a"), "b").agg(F.max("dst").alias("ancestor"))


@query("g_bounded_dijkstra", f"with recursive {LK}, s as (select n::bigint as source, n::bigint as node, 0.0::double as dist, 0 as hops from (values (1), (2), (5)) t(n) union select source, dst, dist + weight, hops + 1 from s join lk on node = src where hops < 12 and dist + weight <= 6) select source, node, round(min(dist), 6) as dist from s group by all")
def _(spark, d):
    return G.shortest(links(spark, d), spark.createDataFrame([(1,), (2,), (5,)], "n long"), bound=6.0).select("source", "node", r6("dist").alias("dist"))


@query("g_k_step_relax", f"with recursive {LK}, s as (select 1::bigint as node, 0.0::double as dist, 0 as hops union select dst, dist + weight, hops + 1 from s join lk on node = src where hops < 3) select node, round(min(dist), 6) as dist from s group by 1")
def _(spark, d):
    return G.shortest(links(spark, d), spark.createDataFrame([(1,)], "n long"), steps=3).select("node", r6("dist").alias("dist"))


@query("g_apsp_landmark", f"""with recursive {LK}, l as (select src as n from lk group by 1 order by count(*) desc, 1 limit 3), s as (select n as source, n as node, 0.0::double as dist, 0 as hops from l union select source, dst, dist + weight, hops + 1 from s join (select src, dst, weight from lk union all select dst, src, weight from lk) on node = src where hops < 10 and dist + weight <= 5),
    b as (select source, node, min(dist) as dist from s group by all) select x.node as a, y.node as b, round(min(x.dist + y.dist), 6) as dist from b x join b y using (source) where x.node < y.node group by all""")
def _(spark, d):
    """Distances within a bound through the best landmark. Three landmarks and the bound keep each landmark's ball small; pairs come from balls, not from all nodes."""
    e = links(spark, d)
    marks = e.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(3).select("n")
    ball = G.shortest(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), marks, bound=5.0)
    other = ball.select("source", F.col("node").alias("b"), F.col("dist").alias("d2"))
    return ball.join(other, "source").where("node < b").groupBy(F.col("node").alias("a"), "b").agg(r6(F.min(F.col("dist") + F.col("d2"))).alias("dist"))


@query("g_multi_hop_rec", f"""with recursive {LK}, p as (select src as start, dst as node, 1 as hops, weight as cost, [src, dst] as path from lk where src in (1, 2, 5) union all select start, dst, hops + 1, cost + weight, list_append(path, dst) from p join lk on node = src where hops < 3 and not list_contains(path, dst)),
    b as (select start, node, min(cost) as cost from p group by all), s as (select start, node, 0.8 * (1 / (1 + cost) + p_size / 50.0 * 0.5) + 0.2 * (1 - p_size / 50.0) as score from b join part on p_partkey = node)
    select start, node, round(score, 6) as score from (select *, row_number() over (partition by start order by score desc, node) as i from s) where i <= 5""")
def _(spark, d):
    best = G.paths(links(spark, d), spark.createDataFrame([(1,), (2,), (5,)], "n long"), 3).groupBy("start", "node").agg(F.min("cost").alias("cost"))
    semantic = F.col("p_size") / 50
    s = best.join(table(spark, d, "part"), F.col("node") == F.col("p_partkey")).withColumn("score", 0.8 * (1 / (1 + F.col("cost")) + semantic * 0.5) + 0.2 * (1 - semantic))
    return G.top_per(s, "start", 5, F.desc("score"), "node").select("start", "node", r6("score").alias("score"))


@query("g_purity", "with c as (select vec_id % 7 as cluster, label, count(*) as n from embeddings group by all) select cluster, round(max(n) / sum(n), 6) as purity from c group by 1")
def _(spark, d):
    c = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 7).alias("cluster"), "label").agg(F.count("*").alias("n"))
    return c.groupBy("cluster").agg(r6(F.max("n") / F.sum("n")).alias("purity"))


@query("g_hyper_collab", "with e as (select distinct l_orderkey as h, l_suppkey as v from lineitem) select a.v as a, b.v as b, count(*) as n from e a join e b on a.h = b.h and a.v < b.v group by all having count(*) >= 3")
def _(spark, d):
    """Members that share at least three hyperedges; an order has few lines, so pairs stay linear in the orders."""
    return pairs_within(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")


@query("g_hyper_agg", "select size, count(*) as edges from (select l_orderkey, count(distinct l_suppkey) as size from lineitem group by 1) group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("size")).groupBy("size").agg(F.count("*").alias("edges"))


@query("g_chain_attention", f"""with {ED}, e as (select a.from_id as start, b.to_id as node, a.uplift + b.uplift as uplift, [a.from_id, a.to_id, b.to_id] as path from ed a join ed b on a.to_id = b.from_id)
    select start, node, round(uplift * avg(ep.reward), 6) as score from (select start, node, uplift, unnest(path) as id from e) join ep using (id) group by start, node, uplift""")
def _(spark, d):
    """Chains of two edges, rescored by the mean reward of their nodes."""
    e = causal_edges(spark, d).select("from_id", "to_id", "uplift")
    two = e.join(e.select(F.col("from_id").alias("m"), F.col("to_id").alias("node"), F.col("uplift").alias("u2")), F.col("to_id") == F.col("m"))
    hops = two.select(F.col("from_id").alias("start"), "node", (F.col("uplift") + F.col("u2")).alias("u"), F.explode(F.array("from_id", "to_id", "node")).alias("id"))
    return hops.join(episodes(spark, d).select("id", "reward"), "id").groupBy("start", "node", "u").agg(r6(F.col("u") * F.avg("reward")).alias("score")).select("start", "node", "score")


@query("g_skill_plan", f"with {LK} select src as skill, count(*) filter (weight < 2) as prerequisites, count(*) filter (weight >= 2 and weight < 5) as alternatives, count(*) filter (weight >= 5) as refinements from lk group by 1")
def _(spark, d):
    n = lambda x: F.count_if(F.expr(x))
    return links(spark, d).groupBy(F.col("src").alias("skill")).agg(n("weight < 2").alias("prerequisites"), n("weight >= 2 and weight < 5").alias("alternatives"), n("weight >= 5").alias("refinements"))


@query("g_louvain")
def _(spark, d):
    """Communities by synchronous local moves with modularity gain."""
    return G.local_moves(links(spark, d))


# ---------------------------------------------------------------- certificates


_PROOFS = " union all ".join(f'select b.g::bigint as g, b.pos, {k} as level, (b.i // {2**k}) % 2 = 1 as "left", l.h as sibling from b join l{k} l on l.g = b.g and l.i = xor((b.i // {2**k})::bigint, 1::bigint)' for k in range(14))


@query("p_merkle_proof", f"with {MERKLE}, b as (select c_nationkey as g, c_custkey as pos, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i from customer) {_PROOFS}")
def _(spark, d):
    """Sibling hashes of every chunk, level by level."""
    c = table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) as g", "c_custkey as pos", "sha2(cast(c_name as binary), 256) as h")
    return merkle_proofs(c, "g", "pos", "h")


@query("p_redundancy", "select l_orderkey, round(count(*) / count(distinct l_suppkey), 6) as redundancy from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.count("*") / F.countDistinct("l_suppkey")).alias("redundancy"))


@query("p_audit", "select o_orderkey, count(l_orderkey) as chunks, round(coalesce(avg(l_quantity / 50), 0), 6) as necessity from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def _(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("chunks"), r6(F.coalesce(F.avg(F.col("l_quantity") / 50), F.lit(0.0))).alias("necessity"))


@query("g_provenance_graph", "select 'o' || l_orderkey as src, 'p' || l_partkey as dst, 'chunk' as kind from lineitem union select 'o' || o_orderkey, 'c' || o_custkey, 'query' from orders")
def _(spark, d):
    a = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey) as src", "concat('p', l_partkey) as dst", "'chunk' as kind")
    return a.union(table(spark, d, "orders").selectExpr("concat('o', o_orderkey)", "concat('c', o_custkey)", "'query'")).distinct()


@query("sup_pivots", f"""with recursive {UP}, z as (select dst as node, count(*) as size from u group by 1), h as (select src as node, count(*) - 1 as depth from u group by 1), p as (select depth as pd, row_number() over (order by node) - 1 as place from z join h using (node) where size >= (select count(*) // 16 from part)),
    g as (select node, arg_min(place, (abs(depth - pd), place)) as place from h, p group by 1) select node, (place % 4)::bigint as part from g""")
def _(spark, d):
    """Classes with a sixteenth of all under them are pivots, 31 at most in a binary tree; each class goes to the pivot of nearest depth."""
    up = G.closure(tree(spark, d)).unionByName(classes(spark, d))
    size, depth = up.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("size")), up.groupBy(F.col("src").alias("node")).agg((F.count("*") - 1).alias("dist"))
    least = table(spark, d, "part").count() // 16
    pivots = size.where(F.col("size") >= least).join(depth, "node").withColumn("place", F.row_number().over(Window.orderBy("node")) - 1)
    return G.nearest_pivots(depth, pivots, 4).select("node", F.col("part").cast("long").alias("part"))
