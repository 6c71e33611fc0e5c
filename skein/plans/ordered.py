"""Numbers and running sums along an order within keys, whatever share of the rows one key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.scratch import fresh_name, materialise


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Add ``number`` (1, 2, ... in order within the keys) and, under the names of ``sums``, their sums over this row and those before.

    Rows are dealt out by ranges of keys and order and stored; windows run within a key and
    a range, and a small table of the ranges' counts and sums adds what stands before. So a
    key of any size spreads over ranges. ``order`` has to be total within a key.
    """
    sums = sums or {}
    at, had = fresh_name(df, "at"), [fresh_name(df, f"had{i}") for i in range(len(sums) + 1)]
    stored = materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(at, F.spark_partition_id()), "ordered")
    inside = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy(*keys, at).agg(F.count("*").alias(had[0]), *[F.sum(x).alias(h) for x, h in zip(sums.values(), had[1:])])
    totals = totals.select(*[F.col(k).alias(f"{had[0]}_{k}") for k in keys], F.col(at).alias(f"{had[0]}_at"), *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(h) for h in had])
    totals = materialise(totals, "offsets")  # a row for each key and range
    met = F.col(at) == F.col(f"{had[0]}_at")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{had[0]}_{k}"))
    local = stored.withColumn(number, F.count(F.lit(1)).over(inside))
    for name, x in sums.items():
        local = local.withColumn(name, F.coalesce(F.sum(x).over(inside), F.lit(0)))
    joined = local.join(totals, met).withColumn(number, F.col(number) + F.col(had[0]))
    for name, h in zip(sums, had[1:]):
        joined = joined.withColumn(name, F.col(name) + F.col(h))
    return joined.select(*df.columns, number, *sums)
