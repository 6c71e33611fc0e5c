"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.scratch import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Label every vertex of an undirected edge list with its component's least id.

    Returns ``(node, component)`` for each vertex that has an edge to another
    vertex. Self loops, repeated edges and rows with a null end add nothing; an
    empty edge list gives an empty table. Each round re-hangs neighbours below
    the least id near them (published as large-star / small-star), so chains
    shorten geometrically. Minima are partly aggregated before the shuffle, and
    a vertex with very many edges is only ever the probe side of a sort-merge
    join, which adaptive execution can split. Rounds are cut by stored tables.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    pairs = materialise(pairs, "edges")
    before = _digest(pairs)
    if before[0] == 0:
        return _labels(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, pairs = pairs, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        now = _digest(pairs)
        if now == before:
            return _labels(pairs)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labels(stars: DataFrame) -> DataFrame:
    """Every leaf with its centre, and every centre with itself."""
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
