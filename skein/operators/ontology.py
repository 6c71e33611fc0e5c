"""Reasoning over class hierarchies and triples, validation rules, and one step of layout forces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import closure


#: Groups of tags that contradict each other.
PARADOXES = (
    (("FamilyFriendly", "Children"), ("Rated-R", "Mature", "Adult")),
    (("Educational",), ("Exploitation", "Gratuitous")),
    (("Peaceful", "Calm"), ("Action", "Horror", "Thriller")),
)


def paradoxes(tags: Column) -> Column:
    """Numbers, from 1, of the rules both sides of which some tag holds as a part."""
    held = lambda words: F.exists(tags, lambda t: reduce(lambda x, y: x | y, [F.contains(t, F.lit(w)) for w in words]))
    return F.array_compact(F.array(*[F.when(held(yes) & held(no), F.lit(i)) for i, (yes, no) in enumerate(PARADOXES, 1)]))


def inherit_disjoint(tree: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``(a, b)``, ``a < b``: classes that are disjoint because they or their ancestors are, stated pairs included."""
    up = closure(tree)
    nodes = tree.select("src").union(tree.select("dst")).union(disjoint.select("a")).union(disjoint.select("b")).distinct()
    under = up.unionByName(nodes.select("src", F.col("src").alias("dst")))
    left = disjoint.join(under.select(F.col("dst").alias("a"), F.col("src").alias("x")), "a")
    pairs = left.join(under.select(F.col("dst").alias("b"), F.col("src").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unsatisfiable(tree: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``node``: classes under both sides of a disjoint pair."""
    up = closure(tree).unionByName(tree.select("src").union(tree.select("dst")).distinct().select("src", F.col("src").alias("dst")))
    one = disjoint.join(up.select(F.col("dst").alias("a"), F.col("src").alias("node")), "a")
    return one.join(up.select(F.col("dst").alias("b"), F.col("src").alias("node")), ["b", "node"]).select("node").distinct()


def conflicts(triples: DataFrame, least: float) -> DataFrame:
    """``(s, p, o, confidence)``: the surest object of each subject and predicate; others at ``least`` or more move to ``p:alternative``, the rest go."""
    best = triples.groupBy("s", "p").agg(F.max_by("o", F.struct("confidence", "o")).alias("best"))
    j = triples.join(best, ["s", "p"])
    first = F.col("o") == F.col("best")
    return j.where(first | (F.col("confidence") >= least)).select("s", F.when(first, F.col("p")).otherwise(F.concat("p", F.lit(":alternative"))).alias("p"), "o", "confidence")


def domain_range(triples: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """``(s, p, o, rule)``: triples whose subject lacks the domain class, or object the range class, of the predicate's rule ``(p, domain, range)``."""
    j = triples.join(rules, "p")
    ends = [("domain", "s"), ("range", "o")]
    out = [j.join(types.select(F.col("node").alias(end), F.col("class").alias(rule)), [end, rule], "left_anti").select("s", "p", "o", F.lit(rule).alias("rule")) for rule, end in ends]
    return out[0].unionByName(out[1])


def forces(nodes: DataFrame, pairs: DataFrame, magnitude: Column, limit: float = 10.0) -> DataFrame:
    """``(node, fx, fy, fz)``: one step of pairwise forces, summed per node.

    ``nodes`` are ``(node, x, y, z, mass, radius)``; ``pairs`` are ``(src, dst, rest, strength)``. ``magnitude`` is an expression over
    ``dist``, ``rest``, ``strength``, ``rs`` and ``rd``: above 0 it draws both ends together, below 0 it drives them apart, and it is
    held within ``limit``. Coinciding ends feel nothing. Each pair adds to both ends, over their masses.
    """
    end = lambda tag, key: nodes.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in ("x", "y", "z", "mass")], F.col("radius").alias(f"r{tag}"))
    j = pairs.join(end("s", "src"), "src").join(end("d", "dst"), "dst")
    gaps = {c: F.col(f"{c}_d") - F.col(f"{c}_s") for c in "xyz"}
    j = j.withColumn("dist", F.sqrt(sum((g * g for g in gaps.values()), F.lit(0.0)))).where("dist > 1e-6")
    size = F.greatest(F.lit(-limit), F.least(F.lit(limit), magnitude))
    pull = {c: size * g / F.col("dist") for c, g in gaps.items()}
    both = F.array(
        F.struct(F.col("src").alias("node"), *[(p / F.greatest("mass_s", F.lit(1e-6))).alias(f"f{c}") for c, p in pull.items()]),
        F.struct(F.col("dst").alias("node"), *[(-p / F.greatest("mass_d", F.lit(1e-6))).alias(f"f{c}") for c, p in pull.items()]),
    )
    return j.select(F.explode(both).alias("e")).select("e.*").groupBy("node").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"])


def hold_apart() -> Column:
    """Disjoint classes: drive ends apart while they are nearer than their radii and the rest distance."""
    room = F.col("rs") + F.col("rd") + F.col("rest")
    return F.when(F.col("dist") < room, -F.col("strength") * (room - F.col("dist")) / room).otherwise(0.0)


def spring() -> Column:
    """Hierarchies, equivalences, moods, cultures and preferences: a spring of the rest distance."""
    return F.col("strength") * (F.col("dist") - F.col("rest"))
