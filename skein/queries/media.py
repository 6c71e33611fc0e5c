"""Media classifiers, context scores, text and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import media as M
from skein.plans.registry import query
from skein.sources.tables import table
from skein.sources.views import EP, episodes

r6 = lambda c: F.round(c, 6)
lits = lambda *xs: F.array(*[F.lit(x) for x in xs])


def parts(spark, d):
    return table(spark, d, "part")


@query("motion_genre", """with m as (select o_orderkey as k, avg(l_quantity / 64) as m, avg(l_linenumber / 8) as f, stddev_pop(l_linenumber / 8) as s from lineitem join orders on l_orderkey = o_orderkey group by 1)
    select k, 'Action' as label from m where m > 0.7 and f > 0.6 union all select k, 'Drama' from m where m < 0.3 and f < 0.3 union all select k, 'Thriller' from m where m > 0.4 and m < 0.7 and s > 0.2""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_quantity") / 64).alias("m"), F.collect_list(F.col("l_linenumber") / 8).alias("f"))
    known = lines.join(table(spark, d, "orders"), F.col("k") == F.col("o_orderkey"), "left_semi")
    return known.select("k", F.explode(M.motion_genres(F.col("m"), F.col("f"))).alias("x")).select("k", "x.label")


@query("lighting_mood", """select p_partkey, case when p_size / 50 > 0.8 and p_retailprice % 10 / 10 < 0.3 then 'HighKey' when p_size / 50 < 0.4 and p_retailprice % 10 / 10 > 0.7 then 'LowKey'
    when p_size * 100 > 3500 then 'WarmLighting' when p_size * 100 < 3000 then 'CoolLighting' end as mood from part""")
def _(spark, d):
    return parts(spark, d).select("p_partkey", M.lighting_mood(F.col("p_size") / 50, F.col("p_retailprice") % 10 / 10, F.col("p_size") * 100).alias("mood"))


@query("complexity_level", """select p_partkey, case when c < 0.3 then 'Children' when c < 0.5 then 'Family' when c < 0.7 then 'General' when c < 0.85 then 'Mature' else 'Academic' end as level,
    round(0.7 + least(least(abs(c - 0.3), abs(c - 0.5), abs(c - 0.7), abs(c - 0.85)) * 0.6, 0.25), 6) as confidence from (select p_partkey, p_size / 50 as c from part)""")
def _(spark, d):
    c = F.col("p_size") / 50
    return parts(spark, d).select("p_partkey", M.complexity_level(c).alias("level"), r6(M.complexity_confidence(c)).alias("confidence"))


@query("sound_marker", """with s as (select p_partkey, p_size / 50 as x from part) select p_partkey, 'Cinematic' as label, round(x, 6) as confidence from s where x > 0.8 union all select p_partkey, 'Immersive', round(x * 0.9, 6) from s where x > 0.8
    union all select p_partkey, 'Professional', round(x, 6) from s where x > 0.6 and x <= 0.8 union all select p_partkey, 'Minimalist', round(1 - x, 6) from s where x < 0.3""")
def _(spark, d):
    return parts(spark, d).select("p_partkey", F.explode(M.sound_markers(F.col("p_size") / 50)).alias("x")).select("p_partkey", "x.label", r6("x.confidence").alias("confidence"))


@query("narrative_arc", f"""with {EP}, a as (select session_id, arg_min(reward, (ts, id)) as s, max(reward) as p, arg_max(reward, (ts, id)) as e, count(*) as n, stddev_pop(reward) as v from ep group by 1)
    select session_id, case when e > s and p > s and e - s > 0.3 then 'HeroJourney' when e < s and s - e > 0.3 then 'Tragedy' when n > 3 and v > 0.3 then 'ComplexNarrative' when abs(e - s) < 0.2 and p - s < 0.3 then 'SliceOfLife' else 'Standard' end as arc from a""")
def _(spark, d):
    at = F.struct("ts", "id")
    a = episodes(spark, d).groupBy("session_id").agg(F.min_by("reward", at).alias("s"), F.max("reward").alias("p"), F.max_by("reward", at).alias("e"), F.count("reward").alias("n"), F.stddev_pop("reward").alias("v"))
    return a.select("session_id", M.narrative_arc(F.col("s"), F.col("p"), F.col("e"), F.col("n"), F.col("v")).alias("arc"))


@query("intensity_fit", """select l_orderkey, l_linenumber::bigint as line, round(case when l_returnflag = 'R' and l_quantity * 20 > 100 then 0.3 when l_returnflag = 'A' and l_quantity * 20 > 500 then 0.6 else 1 end
    * case when l_linestatus = 'O' and l_extendedprice > 3600 then 0.7 else 1 end, 6) as fit from lineitem""")
def _(spark, d):
    net = F.when(F.col("l_returnflag") == "R", "poor").when(F.col("l_returnflag") == "A", "fair").otherwise("excellent")
    device = F.when(F.col("l_linestatus") == "O", "mobile").otherwise("tv")
    fit = M.context_fit(net, device, F.lit("video"), F.col("l_quantity") * 20, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), r6(fit).alias("fit"))


@query("cultural_match", """select p_partkey, round(greatest(0, least(1, (case when l = 'en-US' then 0.3 when l[:2] = 'en' then 0.21 else 0 end + case when contains(l, 'US') then 0.25 else 0 end
    + len(list_filter(g, lambda x: x in ('STANDARD', 'PROMO'))) / greatest(len(g), 2) * 0.25 + case when len(t) > 0 then list_avg(t) * 0.15 else 0 end
    + greatest(-0.5 * len(list_filter(g, lambda x: x = 'SMALL')), -1)) / (0.85 + case when len(t) > 0 then 0.15 else 0 end))), 6) as score
    from (select *, list_transform(list_filter(g, lambda x: x in ('STANDARD', 'ECONOMY')), lambda x: case x when 'STANDARD' then 0.9 else 0.4 end) as t from
        (select p_partkey, string_split(p_type, ' ') as g, case p_size % 3 when 0 then 'en-US' when 1 then 'en-GB' else 'de-DE' end as l from part))""")
def _(spark, d):
    size = F.col("p_size") % 3
    lang = F.array(F.when(size == 0, "en-US").when(size == 1, "en-GB").otherwise("de-DE"))
    g = F.split("p_type", " ")
    taste = F.create_map(F.lit("STANDARD"), F.lit(0.9), F.lit("ECONOMY"), F.lit(0.4))
    return parts(spark, d).select("p_partkey", r6(M.cultural_match(lang, g, g, F.lit("en-US"), F.lit("US"), lits("STANDARD", "PROMO"), taste, lits("SMALL"))).alias("score"))


@query("agg_pref_score", "select p_partkey, round(coalesce(list_avg(list_transform(string_split(p_type, ' '), lambda x: case x when 'STANDARD' then 0.9 when 'ECONOMY' then 0.4 else 0 end)), 0) * 0.3, 6) as score from part")
def _(spark, d):
    taste = F.create_map(F.lit("STANDARD"), F.lit(0.9), F.lit("ECONOMY"), F.lit(0.4))
    return parts(spark, d).select("p_partkey", r6(M.preference(F.split("p_type", " "), taste) * 0.3).alias("score"))


@query("str_hash31", "select p_partkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda h, b: (h * 31 + b) % 4294967296) as h from part")
def _(spark, d):
    return parts(spark, d).select("p_partkey", M.rolling_hash(F.col("p_name")).alias("h"))


@query("str_steps", "select conv_id, turn::bigint as turn, array_to_string(list_distinct(regexp_extract_all(text, '[0-9]+\\. ([a-zA-Z ]+)', 1))[:1], '|') as steps from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.array_join(F.coalesce(M.numbered_steps(F.col("text"), 1), F.array()), "|").alias("steps"))


@query("str_episode_text", f"with {EP} select id, task || chr(10) || case when success then 'worked' else '' end || case when success then chr(10) else '' end || latency::varchar as text from ep")
def _(spark, d):
    return episodes(spark, d).select("id", F.concat_ws("\n", "task", F.when(F.col("success"), "worked"), F.col("latency").cast("string")).alias("text"))


@query("date_window", f"with {EP} select id from ep where ts > (select max(ts) from ep) - interval 7 day")
def _(spark, d):
    e = episodes(spark, d)
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.expr("ts > now - interval 7 days")).select("id")


@query("date_rank_decay", f"with {EP} select id, round(exp(-1e-4 * (row_number() over (partition by session_id order by ts desc, id) - 1)), 6) as weight from ep")
def _(spark, d):
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), "id")) - 1
    return episodes(spark, d).select("id", r6(F.exp(-1e-4 * at)).alias("weight"))


@query("json_extract", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("map_merge", "select distinct p_partkey, w as genre from part, (values ('STANDARD', 'Plain'), ('ECONOMY', 'Plain'), ('PROMO', 'Offer'), ('PROMO', 'Short')) t(k, w) where list_contains(string_split(p_type, ' '), k)")
def _(spark, d):
    known = F.create_map(*[x for k, ws in (("STANDARD", ["Plain"]), ("ECONOMY", ["Plain"]), ("PROMO", ["Offer", "Short"])) for x in (F.lit(k), lits(*ws))])
    found = F.flatten(F.transform(F.split("p_type", " "), lambda g: F.coalesce(F.try_element_at(known, g), F.array().cast("array<string>"))))
    return parts(spark, d).select("p_partkey", F.explode(F.array_distinct(found)).alias("genre"))


@query("hash_ring", """with r as (select min(id % 8) as shard, spot from (select id, ('0x' || substr(md5('node' || id), 1, 4))::bigint as spot from range(512) t(id)) group by spot), c as (select c_custkey, ('0x' || substr(md5('key' || c_custkey), 1, 4))::bigint as place from customer)
    select c_custkey, coalesce(r.shard, (select arg_min(shard, spot) from r))::bigint as shard from c asof left join r on c.place <= r.spot""")
def _(spark, d):
    """Shard of each customer: the first of 8 x 64 virtual nodes at or after the key's place on a ring of 65,536 places.

    The ring is cut into 256 slots; each holds its own nodes and the next one, so a key looks at a few.
    """
    spot = lambda tag, c: F.conv(F.substring(F.md5(F.concat(F.lit(tag), c.cast("string")).cast("binary")), 1, 4), 16, 10).cast("long")
    ring = spark.range(512).select((F.col("id") % 8).alias("shard"), spot("node", F.col("id")).alias("at")).groupBy("at").agg(F.min("shard").alias("shard"))
    every = spark.range(256).select(F.col("id").alias("slot")).join(ring.unionByName(ring.select((F.col("at") + 65536).alias("at"), "shard")), F.col("at") >= F.col("slot") * 256)
    held = F.array_sort(F.collect_list(F.struct("at", "shard")))
    slots = every.groupBy("slot").agg(held.alias("held"), F.count_if(F.col("at") < (F.col("slot") + 1) * 256).alias("own")).select("slot", F.slice("held", F.lit(1), F.col("own").cast("int") + 1).alias("near"))
    keys = table(spark, d, "customer").select("c_custkey", spot("key", F.col("c_custkey")).alias("place"))
    after = F.filter("near", lambda p: p["at"] >= F.col("place"))
    return keys.join(F.broadcast(slots), F.col("slot") == F.floor(F.col("place") / 256)).select("c_custkey", after[0]["shard"].alias("shard"))


@query("math_thompson", f"""with {EP}, a as (select task, avg(reward) as m, var_pop(reward) as v, count(*) as n from ep group by 1), u as (select *, (('0x' || substr(md5('a' || task), 1, 8))::bigint + 1) / 4294967297 as x, ('0x' || substr(md5('b' || task), 1, 8))::bigint / 4294967296 as y from a),
    r as (select task, round(m + sqrt(v / n) * sqrt(-2 * ln(x)) * cos(2 * pi() * y), 6) as draw from u) select * from r order by draw desc, task limit 1""")
def _(spark, d):
    """A normal draw per arm (task) about its mean reward, from hashes of its name; the greatest draw is chosen."""
    arms = episodes(spark, d).groupBy("task").agg(F.avg("reward").alias("m"), F.var_pop("reward").alias("v"), F.count("*").alias("n"))
    part = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(tag), "task").cast("binary")), 1, 8), 16, 10).cast("double")
    normal = F.sqrt(-2 * F.log((part("a") + 1) / 4294967297.0)) * F.cos(2 * F.pi() * part("b") / 4294967296.0)
    return arms.select("task", r6(F.col("m") + F.sqrt(F.col("v") / F.col("n")) * normal).alias("draw")).orderBy(F.desc("draw"), "task").limit(1)


@query("src_synth", "select p_partkey, ('0x' || substr(md5('profile_' || p_partkey), 1, 8))::bigint % 5 as archetype, 18 + ('0x' || substr(md5('age_' || p_partkey), 1, 8))::bigint % 60 as age from part")
def _(spark, d):
    from skein.functions.scalars import md5_int

    seed = lambda tag: md5_int(F.concat(F.lit(tag), F.col("p_partkey").cast("string")))
    return parts(spark, d).select("p_partkey", (seed("profile_") % 5).alias("archetype"), (18 + seed("age_") % 60).alias("age"))
