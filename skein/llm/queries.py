"""Queries over the ten training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from skein.llm import decontaminate, licences, mixing, passages, quality_model, quality_rules, quotes, secrets, simhash, token_files
from skein.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


#: The bisection runs over the list of source shares; as many halvings as the operator makes.
SQL["op1_temperature_mix"] = f"""
with recursive t as (select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents),
s as (select source, count(*) as n_docs, sum(tokens)::bigint as st from t group by 1),
g as (select sum(st)::double as total, list(st order by source) filter (st > 0) as sts from s),
l as (select list_transform(sts, lambda x: x / total) as ps, total from g),
b as (select 0 as i, 0.0::double as lo, 1.0::double as hi union all select i + 1, case when ok then lo else mid end, case when ok then mid else hi end
    from (select i, lo, hi, (lo + hi) / 2 as mid, list_max(list_transform(ps, lambda x: power(x, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda x: power(x, (lo + hi) / 2))) <= 2.0 as ok from b, l where i < {mixing.LEVELS * mixing.ROUNDS})),
a as (select case when list_max(list_transform(ps, lambda x: 1 / x)) / len(ps) <= 2.0 then 0.0 else hi end as a, total from b, l where i = {mixing.LEVELS * mixing.ROUNDS}),
w as (select source, n_docs, st, total, case when st > 0 then power(st / total, a) else 0 end as w from s, a),
bu as (select source, n_docs, st, w / (sum(w) over ()) as weight, w / (sum(w) over ()) * total as budget from w),
p as (select *, coalesce(floor(budget / nullif(st, 0) + 1e-9), 0)::bigint as passes, ceil(sqrt(n_docs))::bigint as n_blocks from bu),
k as (select doc_id, t.source, tokens, weight, passes, st, greatest(0, budget - passes * st) as rest, ('0x' || substr(md5(concat_ws('|', '17', 'block', t.source, doc_id::varchar)), 1, 15))::bigint % n_blocks as block,
    ('0x' || substr(md5(concat_ws('|', '17', 'place', t.source, doc_id::varchar)), 1, 15))::bigint as place from t join p on t.source = p.source),
u as (select *, sum(tokens) over (partition by source, block order by place, doc_id, tokens rows unbounded preceding) as upto from k),
bl as (select source, block, coalesce(sum(n) over (partition by source order by block rows between unbounded preceding and 1 preceding), 0) as before from (select source, block, sum(tokens) as n from k group by all))
select doc_id, u.source, tokens, round(weight, 6) as weight, passes + (st > 0 and before + upto <= rest)::bigint as copies from u join bl on u.source = bl.source and u.block = bl.block"""


@query
def op1_temperature_mix(spark, d):
    """Weights are rounded: their last bits depend on the order of sums."""
    return mixing.mix(table(spark, d, "documents"), max_repeat=2.0).drop("block").withColumn("weight", F.round("weight", 6))


@query
def op2_fourier_quality(spark, d):
    return quality_model.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op3_pigeonhole_leaks(spark, d):
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _prior(rule: str) -> str:
    """Shrunk failure rate of a host for a rule, in SQL over the host sums ``h`` and their moments ``mo``."""
    m = f"least(greatest(m_{rule}, 1e-6), 1 - 1e-6)"
    total = f"least(greatest(case when v_{rule} > 0 then {m} * (1 - {m}) / v_{rule} - 1 else 1e4 end, 1), 1e4)"
    return f"(n_{rule} + {m} * {total}) / (n_docs + {total}) > 0.5 as s_{rule}"


_R = quality_rules.RULES
SQL["op5_host_rules"] = f"""
with w as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
tri as (select doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] as t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, t) as c from tri), range(3) r(k) where c > 1 group by 1),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
m as (select doc_id, host, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(ls) as n_lines from w join l using (doc_id) left join rep using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"n_words > 0 and ({x}) as f_{r}" for r, x in _R.items())} from m),
h as (select host, count(*) as n_docs, {", ".join(f"sum(f_{r}::int) as n_{r}" for r in _R)} from f group by 1),
mo as (select {", ".join(f"avg(n_{r} / n_docs) as m_{r}, var_pop(n_{r} / n_docs) as v_{r}" for r in _R)} from h),
s as (select host, {", ".join(map(_prior, _R))} from h, mo)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and {" + ".join(f"f_{r}::int" for r in _R)} < 2 and not ({" or ".join(f"f_{r} and s_{r}" for r in _R)}) as kept
from f join s using (host)"""


@query
def op5_host_rules(spark, d):
    found = quality_rules.judge(table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_golay_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op8_bit_plane_tokens(spark, d):
    return token_files.round_trip(table(spark, d, "documents"), token_files.default_tokenizer())


@query
def op10_blob_ledger(spark, d):
    return secrets.digest(secrets.scan(table(spark, d, "documents")))


_M = quotes.MARKS
SQL["op4_quote_threads"] = rf"""
with recursive raw as (select row_number() over () as id, conv_id, turn, role, md5(coalesce(text, '')) as mark, string_split_regex(regexp_replace(coalesce(text, ''), '[\x01-\x04]', ' ', 'g'), '\r?\n') as ls from conversations),
l as (select id, i, length(regexp_replace(regexp_extract(x, '{_M}'), '[^>]', '', 'g')) as level, regexp_replace(x, '{_M}', '') as line from (select id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as x from raw)),
n as (select *, regexp_matches(line, '^\s*$') as blank, lead(level) over w as l1, lead(regexp_matches(line, '^\s*$')) over w as b1, lead(level, 2) over w as l2 from l window w as (partition by id order by i)),
k as (select * from n where not (level = 0 and regexp_matches(line, '{quotes.ATTRIBUTION}') and coalesce(l1 > 0 or (l1 = 0 and b1 and l2 > 0), false))),
g as (select *, case when blank then -1 else level end as kind, case when blank then -1 else level end is distinct from lag(case when blank then -1 else level end) over (partition by id order by i) as opens from k),
r as (select id, kind as level, string_agg(line, ' ' order by i) as line from (select *, sum(opens::int) over (partition by id order by i) as run from g) group by id, run, kind having kind >= 0),
u as (select distinct id, level, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) as unit from (select id, level, line as x from r union all select id, level, line from k union all select id, level, unnest(regexp_extract_all(line, '{quotes.SENTENCE}')) from r)),
f as (select id, conv_id, turn from raw where conv_id is not null and turn is not null qualify row_number() over (partition by conv_id, turn order by role nulls first, mark) = 1),
e as (select conv_id, turn, level, unit from u join f using (id) where unit <> ''),
own as (select conv_id, unit, min(turn) as origin from e where level = 0 group by all),
v as (select q.conv_id, q.turn, q.level, o.origin, sum(length(q.unit)) as n from e q join own o on q.conv_id = o.conv_id and q.unit = o.unit and o.origin < q.turn where q.level > 0 group by all),
p as (select conv_id, turn, arg_max(origin, (-level, n, origin)) as parent from v group by all),
t as (select conv_id, turn, parent, parent as root, 1 as depth from p union all select t.conv_id, t.turn, t.parent, p.parent, depth + 1 from t join p on t.conv_id = p.conv_id and t.root = p.turn),
b as (select conv_id, turn, parent, arg_max(root, depth) as root, max(depth) as depth from t group by all),
c as (select id, regexp_replace(string_agg(line, chr(10) order by i), '^\s+|\s+$', '', 'g') as content from k where level = 0 group by id)
select raw.conv_id, coalesce(root, raw.turn) as root, coalesce(depth, 0) as depth, raw.turn, parent, role, coalesce(content, '') as content
from raw left join c on raw.id = c.id left join b on raw.conv_id = b.conv_id and raw.turn = b.turn"""


@query
def op4_quote_threads(spark, d):
    return quotes.conversations(table(spark, d, "conversations"))


@query
def op6_chained_passages(spark, d):
    return passages.classes(passages.repeated_passages(table(spark, d, "documents")))


@query
def op9_licence_paragraphs(spark, d):
    return licences.scan(table(spark, d, "documents"))
