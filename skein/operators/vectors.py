"""Vector arithmetic on array columns, and exact search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.scratch import materialise


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, in doubles."""
    pairs = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_c(a).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where either length is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), lengths))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    gaps = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def l1(a: Column | str, b: Column | str) -> Column:
    """Manhattan distance."""
    gaps = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` takes it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(a: Column | str) -> Column:
    """The vector over its length; null for a zero vector."""
    v = _c(a).cast("array<double>")
    return bound(norm(a), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))


def dims_of(df: DataFrame, vec_col: str = "embedding") -> int:
    """Length of the vectors of a table, from one row; 0 for an empty one."""
    row = df.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    return row[0] if row else 0


def vector_of(df: DataFrame, id_col: str, key, vec_col: str = "embedding") -> list[float]:
    """One stored vector, read by its id: a single row goes to the driver."""
    row = df.where(F.col(id_col) == key).select(vec_col).first()
    if row is None:
        raise KeyError(key)
    return [float(x) for x in row[0]]


def knn(df: DataFrame, query: Sequence[float], id_col: str, vec_col: str, k: int, exclude=None, keep: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """The ``k`` rows most similar to ``query``, ties by id.

    The query is a literal, so the search is one scan with a bounded heap per task.
    """
    if exclude is not None:
        df = df.where(F.col(id_col) != exclude)
    scored = df.select(id_col, *keep, cosine(vec_col, F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def consolidate(df: DataFrame, group: str, id_col: str, vec_col: str, threshold: float = 0.8, block: int = 64) -> DataFrame:
    """``(group, leader, id)``: greedy leaders of each group in order of id; a vector joins the first leader it is more similar to than ``threshold``.

    A round takes the ``block`` least ids left in every group, finds the leaders among
    them in order, and hands out to these all vectors of the group that are left. So no
    group is gathered in one place, every vector gets its leader, and there are about as
    many rounds as the most leaders of a group over ``block``.
    """
    left, out = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null"), None
    while True:
        w = Window.partitionBy("group").orderBy("id")
        first = left.withColumn("i", F.row_number().over(w)).where(F.col("i") <= block).drop("i")
        leaders = first.groupBy("group").applyInPandas(_leaders(threshold), f"group {df.schema[group].dataType.simpleString()}, leaders array<struct<id:long,v:array<double>>>")
        near = F.filter("leaders", lambda x: (x["id"] == F.col("id")) | ((x["id"] < F.col("id")) & (cosine(x["v"], F.col("v")) > threshold)))
        seen = materialise(left.join(leaders, "group").select("group", "id", "v", F.try_element_at(near, F.lit(1))["id"].alias("leader")), "leaders")
        step = seen.where("leader is not null").select("group", "leader", "id")
        out = step if out is None else out.unionByName(step)
        left = seen.where("leader is null").select("group", "id", "v")
        if left.isEmpty():
            return out


def _leaders(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        chosen: list[int] = []
        for i in np.argsort(pdf["id"].to_numpy(), kind="stable"):
            if not chosen or not (u[chosen] @ u[i] > threshold).any():
                chosen.append(int(i))
        rows = [{"id": int(pdf["id"].iloc[i]), "v": m[i].tolist()} for i in chosen]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "leaders": [rows]})

    return run
