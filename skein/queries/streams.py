"""Streams, run over the event table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.plans.registry import query
from skein.plans.scratch import scratch_path
from skein.streaming import events as S


def _run(spark, stream, mode):
    return S.drain(stream, "skein_" + uuid.uuid4().hex, scratch_path(spark, "stream"), mode)


@query("st_hourly", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    out = _run(spark, S.hourly(S.read_events(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st_dedupe", "select distinct event_id from events")
def _(spark, d):
    return _run(spark, S.unique(S.read_events(spark, d)).select("event_id"), "append")


@query("st_user_ema", """with o as (select user_id, value, row_number() over w - 1 as i from events window w as (partition by user_id order by ts, event_id)), a as (select *, case when i = 0 then 1 else 0.1 / (1 + 0.01 * i) end as a from o),
    c as (select *, a * exp(coalesce(sum(ln(1 - a)) over (partition by user_id order by i rows between 1 following and unbounded following), 0)) as c from a) select user_id, count(*) as n, round(sum(c * value), 5) as ema from c group by 1""")
def _(spark, d):
    return _run(spark, S.running_mean(S.read_events(spark, d)), "update").select("user_id", "n", F.round("ema", 5).alias("ema"))
