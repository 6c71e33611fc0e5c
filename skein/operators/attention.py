"""Attention over keyed vectors: softmax and linear kernels, heads, graph neighbourhoods, routed experts, rotary positions, hyperbolic distance.

Queries are joined to the keys of their own group (a session, a neighbourhood), never to all rows. A softmax is
two aggregates, the greatest score and the weighted sum, so a group of any size streams through partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.vectors import bound, dot, l2, norm


def _heads(v: Column, heads: int, dims: int) -> Column:
    """The vector cut into equal heads, numbered."""
    size = dims // heads
    return F.array(*[F.struct(F.lit(h).alias("head"), F.slice(v, h * size + 1, size).alias("v")) for h in range(heads)])


def _weighted(scored: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``(keys, v)``: sum of ``w * x`` over sum of ``w``; a zero sum gives a null vector. One aggregate buffer a key and dimension, no explode."""
    sums = [F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    total = scored.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    return total.select(*keys, F.when(F.col("total") != 0, F.array(*[F.col(f"s{i}") / F.col("total") for i in range(dims)])).alias("v"))


def attend(pairs: DataFrame, dims: int, heads: int = 1, kernel: str = "softmax") -> DataFrame:
    """``(query, v)`` of ``(query, q, k, x)`` pairs, each row a key with its value for a query.

    ``softmax`` scales inner products by the root of the head's size and subtracts the greatest before the exponential;
    ``linear`` weighs by the product of ``elu + 1`` features; ``hyperbolic`` by the softmax of minus the Poincare distance.
    Heads see their own slices and are joined again in order.
    """
    size = dims // heads
    cut = pairs.select("query", F.explode(F.arrays_zip(_heads(F.col("q"), heads, dims).alias("q"), _heads(F.col("k"), heads, dims).alias("k"), _heads(F.col("x"), heads, dims).alias("x"))).alias("p"))
    cut = cut.select("query", F.col("p.q.head").alias("head"), F.col("p.q.v").alias("q"), F.col("p.k.v").alias("k"), F.col("p.x.v").alias("x"))
    if kernel == "linear":
        up = lambda v: F.transform(v, lambda y: F.when(y > 0, y + 1.0).otherwise(F.exp(y)))
        scored = cut.withColumn("w", dot(up(F.col("q")), up(F.col("k"))))
    else:
        score = -poincare("q", "k") if kernel == "hyperbolic" else dot("q", "k") / float(size) ** 0.5
        raw = cut.withColumn("score", score)
        top = raw.groupBy("query", "head").agg(F.max("score").alias("top"))
        scored = raw.join(top, ["query", "head"]).withColumn("w", F.exp(F.col("score") - F.col("top")))
    out = _weighted(scored, ["query", "head"], size)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "v"))), lambda h: h["v"]))
    return out.groupBy("query").agg(whole.alias("v"))


def poincare(a: str, b: str, curve: float = 1.0) -> Column:
    """Distance in the Poincare ball after both vectors are drawn inside it (length n becomes n / (1 + n))."""
    inside = lambda v: bound(1 + norm(v), lambda n: F.transform(F.col(v).cast("array<double>"), lambda x: x / n))
    na, nb = norm(a) / (1 + norm(a)), norm(b) / (1 + norm(b))
    gap = F.pow(l2(inside(a), inside(b)), F.lit(2))
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * gap / ((1 - na * na) * (1 - nb * nb)))) / curve**0.5


def rotary(v: Column, position: Column, dims: int, base: float = 10000.0) -> Column:
    """Pairs of coordinates turned by the position times a falling frequency."""
    out = []
    for i in range(0, dims, 2):
        turn = position * base ** (-i / dims)
        a, b = F.get(v, F.lit(i)).cast("double"), F.get(v, F.lit(i + 1)).cast("double")
        out += [a * F.cos(turn) - b * F.sin(turn), a * F.sin(turn) + b * F.cos(turn)]
    return F.array(*out)


def route(vectors: DataFrame, gates: list[list[float]], most: int = 2) -> DataFrame:
    """``(id, expert, weight)``: the ``most`` experts with the greatest gate scores, ties to the least, with softmax weights over them."""
    scored = F.array(*[F.struct((-dot("v", F.array(*[F.lit(float(x)) for x in g]))).alias("low"), F.lit(i).alias("expert")) for i, g in enumerate(gates)])
    best = F.slice(F.array_sort(scored), 1, most)
    first = vectors.select("id", best.alias("b")).withColumn("top", F.col("b")[0]["low"])
    w = F.transform("b", lambda x: F.struct(x["expert"].alias("expert"), F.exp(F.col("top") - x["low"]).alias("e")))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["e"])
    return first.withColumn("w", w).withColumn("t", total).select("id", "t", F.explode("w").alias("x")).select("id", "x.expert", (F.col("x.e") / F.col("t")).alias("weight"))


def graph_attention(nodes: DataFrame, edges: DataFrame, dims: int, heads: int = 1) -> DataFrame:
    """``(node, v)``: each node's neighbours weighted by the inner product of the head's slices over the sum of weights, then a leaky rectifier.

    Nodes without neighbours keep their own vector; heads whose weights sum to nothing positive keep the plain sum.
    """
    size = dims // heads
    near = edges.join(nodes.select(F.col("node").alias("dst"), F.col("v").alias("x")), "dst").join(nodes.select(F.col("node").alias("src"), F.col("v").alias("q")), "src")
    sums = []
    for h in range(heads):
        w = dot(F.slice("q", h * size + 1, size), F.slice("x", h * size + 1, size))
        sums.append(F.sum(w).alias(f"w{h}"))
        sums += [F.sum(w * F.get("x", F.lit(h * size + i)).cast("double")).alias(f"s{h * size + i}") for i in range(size)]
    held = near.groupBy(F.col("src").alias("node")).agg(*sums)
    cells = []
    for i in range(dims):
        x = F.col(f"s{i}") / F.when(F.col(f"w{i // size}") > 0, F.col(f"w{i // size}")).otherwise(1.0)
        cells.append(F.when(x > 0, x).otherwise(0.01 * x))
    return nodes.join(held.select("node", F.array(*cells).alias("new")), "node", "left").select("node", F.coalesce("new", F.col("v").cast("array<double>")).alias("v"))
