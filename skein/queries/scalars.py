"""Filters, projections, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators.filters import compile_filter, json_field, map_equals
from skein.operators.pairs import scored_pairs
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import EP, episodes


def _meta(spark, d):
    """Parts with a size that is missing for every seventh."""
    return table(spark, d, "part").withColumn("size", F.expr("case when p_size % 7 <> 0 then p_size end"))


_META = "(select *, case when p_size % 7 <> 0 then p_size end as size from part)"
for _name, _spec, _where in (
    ("flt_mongo_eq", {"size": {"$eq": 11}}, "size = 11"),
    ("flt_mongo_ne", {"size": {"$ne": 11}}, "size is distinct from 11"),
    ("flt_mongo_gt", {"size": {"$gt": 40}}, "size > 40"),
    ("flt_mongo_gte", {"size": {"$gte": 40}}, "size >= 40"),
    ("flt_mongo_lt", {"size": {"$lt": 5}}, "size < 5"),
    ("flt_mongo_lte", {"size": {"$lte": 5}}, "size <= 5"),
    ("flt_mongo_in", {"p_brand": {"$in": ["Brand#2", "Brand#17"]}}, "p_brand in ('Brand#2', 'Brand#17')"),
    ("flt_mongo_nin", {"size": {"$nin": [1, 2, 3]}}, "size is null or size not in (1, 2, 3)"),
    ("flt_mongo_contains", {"p_name": {"$contains": "ring"}}, "contains(p_name, 'ring')"),
    ("flt_mongo_exists", {"size": {"$exists": False}}, "size is null"),
    ("flt_mongo_compile", {"p_type": "ECONOMY", "size": {"$gte": 10, "$lt": 30}, "p_brand": {"$ne": "Brand#2"}}, "p_type = 'ECONOMY' and size >= 10 and size < 30 and p_brand <> 'Brand#2'"),
):
    query(_name, f"select p_partkey, p_brand, size::bigint as size from {_META} where {_where}")(
        lambda spark, d, spec=_spec: _meta(spark, d).where(compile_filter(spec)).selectExpr("p_partkey", "p_brand", "cast(size as bigint) as size")
    )


@query("prj_json_path", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as bigint) > 50")
def _(spark, d):
    k = json_field("props")("k").cast("long")
    return table(spark, d, "events").where(k > 50).select("event_id", k.alias("k"))


@query("flt_episode", f"with {EP} select id, reward from ep where reward >= 0.1 and success and ts > (select max(ts) from ep) - interval 7 day")
def _(spark, d):
    e = episodes(spark, d)
    asof = e.agg(F.max("ts")).first()[0]
    return e.where((F.col("reward") >= 0.1) & F.col("success") & (F.col("ts") > F.lit(asof).cast("timestamp_ntz") - F.expr("interval 7 days"))).select("id", "reward")


@query("flt_pattern", "select p_partkey from part where p_type = 'ECONOMY' and len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) > 0")
def _(spark, d):
    return table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring")))).select("p_partkey")


@query("flt_media", "select p_partkey from part where lower(p_type) in ('economy', 'promo') and p_retailprice >= 905 and p_size between 5 and 30")
def _(spark, d):
    return table(spark, d, "part").where(F.lower("p_type").isin("economy", "promo") & (F.col("p_retailprice") >= 905) & F.col("p_size").between(5, 30)).select("p_partkey")


@query("flt_meta_equal", "select p_partkey from part where p_type = 'ECONOMY' and p_brand = 'Brand#2'")
def _(spark, d):
    meta = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    return table(spark, d, "part").withColumn("meta", meta).where(map_equals("meta", {"type": "ECONOMY", "brand": "Brand#2"})).select("p_partkey")


@query("flt_genome_strong", "select l_partkey as item, list_sort(list(distinct l_suppkey)) as tags from lineitem where l_discount > 0.05 group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_partkey").alias("item")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("tags"))


@query("prj_case_outcome", f"with {EP} select id, case when task = 'click' then latency::double when success then 1.0 else reward end as outcome from ep")
def _(spark, d):
    return episodes(spark, d).select("id", F.when(F.col("task") == "click", F.col("latency").cast("double")).when(F.col("success"), 1.0).otherwise(F.col("reward")).alias("outcome"))


@query("prj_effect_direction", f"with {EP} select id, case when reward > 0.1 then 'positive' when reward < 0.1 then 'negative' else 'neutral' end as direction, round((reward - 0.1) * latency, 6) + 0.0::double as strength from ep")
def _(spark, d):
    e = episodes(spark, d)
    sign = F.when(F.col("reward") > 0.1, "positive").when(F.col("reward") < 0.1, "negative").otherwise("neutral")
    return e.select("id", sign.alias("direction"), (F.round((F.col("reward") - 0.1) * F.col("latency"), 6) + F.lit(0.0)).alias("strength"))


@query("prj_composite", f"with {EP} select task, round(0.4 * avg(success::int) + 0.0001 * count(*) + 0.6 * coalesce(avg(reward), 0), 6) as score from ep group by 1")
def _(spark, d):
    g = episodes(spark, d).groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("s"), F.count("*").alias("n"), F.avg("reward").alias("r"))
    return g.select("task", F.round(0.4 * F.col("s") + 0.0001 * F.col("n") + 0.6 * F.coalesce("r", F.lit(0.0)), 6).alias("score"))


@query("str_year", r"""select p_partkey, coalesce(nullif(regexp_extract(t, '^(.+?)\s*\((\d{4})\)\s*$', 1), ''), t) as name, coalesce(try_cast(regexp_extract(t, '^(.+?)\s*\((\d{4})\)\s*$', 2) as bigint), 0) as year
    from (select p_partkey, case when p_partkey % 5 = 0 then p_name else p_name || ' (' || (1950 + p_size)::varchar || ')' end as t from part)""")
def _(spark, d):
    t = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(")")))
    name, year = S.title_year(t)
    return table(spark, d, "part").select("p_partkey", name.alias("name"), year.alias("year"))


@query("str_pad_id", "select 'user_' || lpad(c_custkey::varchar, 8, '0') as user_id from customer")
def _(spark, d):
    return table(spark, d, "customer").select(S.pad_id("user_", 8, F.col("c_custkey")).alias("user_id"))


@query("str_split_genres", "select p_partkey, case when p_partkey % 4 = 0 then []::varchar[] else string_split(replace(p_name, ' ', '|'), '|') end as genres from part")
def _(spark, d):
    text = F.when(F.col("p_partkey") % 4 == 0, "(no genres listed)").otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("|")))
    return table(spark, d, "part").select("p_partkey", S.split_genres(text).alias("genres"))


@query("str_norm_tag", "select p_partkey, regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9_]', '_', 'g') as tag from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.norm_tag(F.concat_ws(" ", "p_brand", "p_type")).alias("tag"))


@query("str_media_text", "select p_partkey, concat_ws('. ', p_name, case when p_size > 25 then p_type end, p_brand) as text from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(". ", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")), "p_brand").alias("text"))


@query("str_combined_text", "select p_partkey, concat_ws(' | ', p_name, nullif(case when p_size > 25 then '' else p_type end, '')) as text from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.joined(" | ", F.col("p_name"), F.when(F.col("p_size") > 25, "").otherwise(F.col("p_type"))).alias("text"))


@query("str_title_score", "select p_partkey, round(case when contains(lower(p_name), 'ring') then 4.0 / length(p_name) else 0 end, 6) as score from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.title_score(F.col("p_name"), "ring"), 6).alias("score"))


@query("str_title_match", "select p_partkey, case when lower(p_name) = 'red ring' then 1.0 when contains(lower(p_name), 'red ring') then 0.95 when contains(lower(p_name), 'red') then 0.85 else 0.8 end::double as score from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.title_match(F.col("p_name"), "red ring").alias("score"))


@query("str_explain", f"with {EP} select id, case when reward >= 0.8 then 'very similar' when reward >= 0.5 then 'similar' when reward >= 0.2 then 'related' else 'distant' end as band from ep")
def _(spark, d):
    return episodes(spark, d).select("id", S.explain(F.col("reward")).alias("band"))


@query("str_template", "select p_partkey, 'Because you liked ' || p_name || ' by ' || p_brand as text from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.render("Because you liked {item} by {brand}", {"item": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("str_label_iri", "select page_id, string_split_regex(url, '[#/]')[-1] as label from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.iri_label(F.col("url")).alias("label"))


@query("hash_sha256", "select doc_id, sha256(text) as hash from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("hash_md5_seed", "select c_custkey, ('0x' || substr(md5(c_name), 1, 8))::bigint % 8 as bucket from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", (S.md5_int(F.col("c_name")) % 8).alias("bucket"))


@query("date_iso", "select event_id, strftime(to_timestamp(epoch(ts)::bigint) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as iso from (select event_id, date_trunc('second', ts) as ts from events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.iso_time(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso"))


@query("date_tod", "select event_id, case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 21 then 'evening' when hour(ts) >= 22 then 'night' else 'late_night' end as tod from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.time_of_day(F.col("ts")).alias("tod"))


@query("date_dow", "select event_id, dayname(ts) as dow from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "EEEE").alias("dow"))


@query("date_decay", "select event_id, round(exp(-ln(2) * latency / 30), 6) as w from (select event_id, cast(json_extract_string(props, '$.k') as double) as latency from events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.decay(json_field("props")("k").cast("double"), 30.0), 6).alias("w"))


@query("math_reward", f"""with {EP} select id, round(greatest(0, least(1, reward)), 6) as standard, success::int::double as sparse, round(greatest(0, least(1, 0.5 * reward + 0.5 * success::int)), 6) as dense,
    round(greatest(0, least(1, reward * (1 - least(latency / 1000, 1.0) * 0.1) + 0.1 * success::int)), 6) as shaped from ep""")
def _(spark, d):
    e = episodes(spark, d)
    return e.select("id", *[F.round(S.reward(m, F.col("success"), F.col("reward"), F.col("latency")), 6).alias(m) for m in ("standard", "sparse", "dense", "shaped")])


@query("math_rating01", "select l_orderkey, l_linenumber::bigint as line, round((1 + 4 * (l_quantity - 1) / 49 - 1) / 4, 6) as r from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "cast(l_linenumber as bigint) as line", "round((1 + 4 * (l_quantity - 1) / 49 - 1) / 4, 6) as r")


@query("math_confidence", f"with {EP} select task, round(least(count(*) / 100, 1) * least(abs(avg(reward)) / 0.5, 1), 6) as a, round(least(least(count(*) / 10, 1) * avg(success::int), 0.99), 6) as b from ep group by 1")
def _(spark, d):
    g = episodes(spark, d).groupBy("task").agg(F.count("*").alias("n"), F.avg("reward").alias("u"), F.avg(F.col("success").cast("int")).alias("s"))
    a = F.least(F.col("n") / 100, F.lit(1.0)) * F.least(F.abs("u") / 0.5, F.lit(1.0))
    return g.select("task", F.round(a, 6).alias("a"), F.round(F.least(F.least(F.col("n") / 10, F.lit(1.0)) * F.col("s"), F.lit(0.99)), 6).alias("b"))


@query("math_ucb1", f"with {EP} select task, round(avg(reward) + sqrt(2 * ln((select count(*) from ep)) / count(*)), 6) as ucb from ep group by 1")
def _(spark, d):
    e = episodes(spark, d)
    return e.groupBy("task").agg(F.avg("reward").alias("q"), F.count("*").alias("n")).select("task", F.round(S.ucb1(F.col("q"), F.col("n"), F.lit(e.count())), 6).alias("ucb"))


@query("arr_jaccard", """select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) as jaccard
    from (select p_partkey, list_distinct(string_split(p_name, ' ')) as x, p_brand from part) a join (select p_partkey, list_distinct(string_split(p_name, ' ')) as y, p_brand from part) b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey""")
def _(spark, d):
    words = lambda x: F.array_distinct(F.split(x, " "))
    alike = lambda x, y: F.round(S.jaccard(words(x), words(y)), 6)
    return scored_pairs(table(spark, d, "part"), "p_brand", "p_partkey", "p_name", alike).withColumnRenamed("score", "jaccard")


@query("bit_jaccard", "select p_partkey, round(case when (p_size | (p_partkey % 64)) = 0 then 0 else bit_count((p_size & (p_partkey % 64))::bigint)::double / bit_count((p_size | (p_partkey % 64))::bigint) end, 6) as j from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.bit_jaccard(F.col("p_size").cast("long"), F.col("p_partkey") % 64), 6).alias("j"))


@query("math_vad", "select p_partkey, round(1 - sqrt((power(p_size / 50 - 0.5, 2) + power(p_partkey % 10 / 10 - 0.2, 2) + power(p_partkey % 7 / 7 - 0.9, 2)) / 3), 6) as sim from part")
def _(spark, d):
    mine = [F.col("p_size") / 50, F.col("p_partkey") % 10 / 10, F.col("p_partkey") % 7 / 7]
    return table(spark, d, "part").select("p_partkey", F.round(S.mood_distance(mine, [F.lit(0.5), F.lit(0.2), F.lit(0.9)]), 6).alias("sim"))


@query("math_entropy", f"with {EP}, c as (select session_id, task, count(*) as n from ep group by all) select session_id, round(-sum(n / t * log2(n / t)), 6) as bits from (select *, sum(n) over (partition by session_id) as t from c) group by 1")
def _(spark, d):
    c = episodes(spark, d).groupBy("session_id", "task").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.collect_list("n").alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("session_id", F.round(S.entropy(F.transform("ns", lambda x: x / total)), 6).alias("bits"))


@query("color_aesthetic", """with c as (select p_partkey, ('0x' || substr(md5(p_name), 1, 2))::bigint / 255 as r, ('0x' || substr(md5(p_name), 3, 2))::bigint / 255 as g, ('0x' || substr(md5(p_name), 5, 2))::bigint / 255 as b from part)
    select p_partkey, case when 0.299 * r + 0.587 * g + 0.114 * b < 0.25 then 'noir' when case when greatest(r, g, b) = 0 then 0 else (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) end > 0.6 then 'vibrant'
    when 0.299 * r + 0.587 * g + 0.114 * b > 0.7 then 'pastel' else 'neutral' end as look from c""")
def _(spark, d):
    color = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6))
    return table(spark, d, "part").select("p_partkey", S.aesthetic(color).alias("look"))


@query("set_union_all", "select 'customer' as kind, c_custkey as id from customer union all select 'supplier', s_suppkey from supplier union all select 'part', p_partkey from part")
def _(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(k).alias("id")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set_union_distinct", "select c_nationkey::bigint as k from customer union select s_nationkey from supplier")
def _(spark, d):
    return table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) as k").union(table(spark, d, "supplier").selectExpr("cast(s_nationkey as bigint) as k")).distinct()


@query("set_intersect", "select distinct c_nationkey::bigint as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").selectExpr("cast(c_nationkey as bigint) as k").intersect(table(spark, d, "supplier").selectExpr("cast(s_nationkey as bigint) as k"))


@query("set_except", "select p_partkey as k from part except select l_partkey from lineitem")
def _(spark, d):
    parts, used = table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()
    return parts.join(used, "k", "left_anti")


@query("set_seen_first", """select k, src from (select k, src, row_number() over (partition by k order by pri) as rn from (
    select c_nationkey::bigint as k, 'customer' as src, 1 as pri from customer union all select s_nationkey, 'supplier', 2 from supplier union all select n_nationkey, 'nation', 3 from nation)) where rn = 1""")
def _(spark, d):
    parts = [table(spark, d, t).select(F.col(k).cast("long").alias("k"), F.struct(F.lit(i).alias("pri"), F.lit(t).alias("src")).alias("s")) for i, (t, k) in enumerate((("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k").agg(F.min("s").alias("s")).select("k", "s.src")
