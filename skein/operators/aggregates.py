"""Aggregations: vectors by group, statistics of effects, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.vectors import dims_of


def mean_vector(df: DataFrame, key: str, vec_col: str, weight: Column | None = None, dims: int | None = None) -> DataFrame:
    """``(key, vector)``: weighted mean of vectors by group; null where the weights sum to 0 or are all null.

    One aggregate buffer a key with a sum for each of ``dims`` positions (read from a row
    if not given): no explode, and partial sums before the shuffle. Rows without a vector
    or a weight count for nothing; vectors are of one length.
    """
    n = dims_of(df, vec_col) if dims is None else dims
    w = F.when(F.col(vec_col).isNotNull(), F.lit(1.0) if weight is None else weight.cast("double"))
    rows = df.select(key, w.alias("w"), F.col(vec_col).alias("x"))
    sums = rows.groupBy(key).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(n)])
    return sums.select(key, F.when(F.col("w") != 0, F.array(*[F.col(f"s{i}") / F.col("w") for i in range(n)])).alias("vector"))


def uplift(df: DataFrame, flag: str, outcome: str, *keys: str) -> DataFrame:
    """Mean difference of treated and others with pooled error, t, approximate p and interval.

    Variances are population variances, the interval uses 1.96 and p a closed form: approximations by design.
    """
    on = F.col(flag)
    g = df.groupBy(*keys).agg(
        *[f(F.when(on == v, F.col(outcome))).alias(f"{n}{i}") for v, i in ((True, 1), (False, 0)) for f, n in ((F.avg, "m"), (F.var_pop, "v"), (F.count, "n"))]
    )
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    up = F.col("m1") - F.col("m0")
    g = g.where("n1 > 0 and n0 > 0").withColumn("uplift", up).withColumn("se", se).withColumn("t_approx", F.when(se == 0, 0.0).otherwise(F.try_divide(up, se)))
    p = 2 * (1 - F.abs("t_approx") / F.sqrt(1 + F.col("t_approx") * F.col("t_approx")) / 2 - 0.5)
    return g.select(*keys, "uplift", "se", "t_approx", p.alias("p_approx"), (F.col("uplift") - 1.96 * F.col("se")).alias("low"), (F.col("uplift") + 1.96 * F.col("se")).alias("high"))


def minmax(df: DataFrame, col: str, out: str, flat: float | None = None) -> DataFrame:
    """Scale a column to 0..1 over the whole table; a flat column stays (or takes ``flat``). One row of bounds is joined, not a global window."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None or low == high:
        return df.withColumn(out, F.col(col) if flat is None else F.lit(flat))
    return df.withColumn(out, (F.col(col) - low) / (high - low))


def zscore(df: DataFrame, col: str, out: str) -> DataFrame:
    mean, spread = df.agg(F.avg(col), F.stddev_pop(col)).first()
    return df.withColumn(out, F.lit(0.0) if not spread else (F.col(col) - mean) / spread)


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by index floor(n * share), not interpolated."""
    w = Window.partitionBy(key).orderBy(value)
    rows = df.select(key, value, F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    pick = [F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * s) + 1, F.col("n")), F.col(value))).alias(k) for k, s in shares.items()]
    return rows.groupBy(key).agg(F.max("n").alias("n"), F.avg(value).alias("mean"), *pick)
