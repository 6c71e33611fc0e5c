"""Attention, forces, hash proofs, communities and rules against small cases worked by hand or numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import media as M
from skein.operators import attention as T
from skein.operators import graph as G
from skein.operators import ontology as O
from skein.operators.indexes import choose
from skein.operators.provenance import merkle_proofs, merkle_roots
from skein.operators.sequential import hitting_set

rng = np.random.default_rng(3)


@pytest.mark.parametrize("heads", [1, 2])
def test_softmax_attention(spark, heads):
    q, k, x = rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    pairs = spark.createDataFrame([(i, q[i].tolist(), k[j].tolist(), x[j].tolist()) for i in range(3) for j in range(5)], "query int, q array<double>, k array<double>, x array<double>")
    got = {r["query"]: r["v"] for r in T.attend(pairs, 4, heads=heads).collect()}
    size = 4 // heads
    for i in range(3):
        want = []
        for h in range(heads):
            s = slice(h * size, h * size + size)
            w = np.exp(k[:, s] @ q[i, s] / np.sqrt(size))
            want += list(w @ x[:, s] / w.sum())
        assert np.allclose(got[i], want)


def test_graph_attention_keeps_lone_nodes(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, [-1.0, 4.0])], "node int, v array<double>")
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    got = {r["node"]: r["v"] for r in T.graph_attention(nodes, edges, 2).collect()}
    assert got == {1: [0.5, 2.0], 2: [0.5, 2.0], 3: [-1.0, 4.0]}


def test_rotary_keeps_length(spark):
    row = spark.createDataFrame([([3.0, 4.0, 1.0, 2.0], 5)], "v array<double>, p int").select(T.rotary(F.col("v"), F.col("p"), 4).alias("r")).first()
    assert np.isclose(np.linalg.norm(row["r"]), np.sqrt(30))


def test_forces_oppose(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 0.0, 2.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0, 1.0)], "node int, x double, y double, z double, mass double, radius double")
    pairs = spark.createDataFrame([(1, 2, 1.0, 0.6), (1, 3, 1.0, 0.6)], "src int, dst int, rest double, strength double")
    got = {r["node"]: r["fx"] for r in O.forces(nodes, pairs, O.hold_apart()).collect()}
    assert got == pytest.approx({1: -0.4, 2: 0.2})


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_proofs_reach_the_root(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(leaves)], "g int, pos int, h string")
    root = merkle_roots(df, "g", "pos", "h").first()["root"]
    steps = merkle_proofs(df, "g", "pos", "h").collect()
    for i, h in enumerate(leaves):
        for s in sorted((s for s in steps if s["pos"] == i), key=lambda s: s["level"]):
            h = hashlib.sha256((s["sibling"] + h if s["left"] else h + s["sibling"]).encode()).hexdigest()
        assert h == root


def test_communities_of_two_cliques(spark):
    clique = lambda a: [(a + i, a + j) for i in range(4) for j in range(i + 1, 4)]
    edges = spark.createDataFrame(clique(0) + clique(10) + [(3, 10)], "src long, dst long")
    labels = {r["node"]: r["label"] for r in G.local_moves(edges).collect()}
    assert len({labels[i] for i in range(3)}) == 1 and len({labels[i] for i in range(11, 14)}) == 1 and labels[0] != labels[12]


def test_disjointness_is_inherited(spark):
    tree = spark.createDataFrame([(3, 1), (4, 2), (5, 3), (5, 4)], "src long, dst long")
    stated = spark.createDataFrame([(1, 2)], "a long, b long")
    assert {tuple(r) for r in O.inherit_disjoint(tree, stated).collect()} >= {(1, 2), (3, 4), (1, 4), (2, 3)}
    assert [r["node"] for r in O.unsatisfiable(tree, stated).collect()] == [5]


def test_conflicts_keep_the_surest(spark):
    t = spark.createDataFrame([("a", "p", "x", 0.9), ("a", "p", "y", 0.7), ("a", "p", "z", 0.2)], "s string, p string, o string, confidence double")
    assert {(r["p"], r["o"]) for r in O.conflicts(t, 0.6).collect()} == {("p", "x"), ("p:alternative", "y")}


def test_hitting_set_is_greedy(spark):
    cover = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (2, 9, "a")], "query long, chunk long, requirement string")
    assert sorted(tuple(r) for r in hitting_set(cover).collect()) == [(1, 2, 1), (1, 3, 2), (2, 9, 1)]


def test_media_bands(spark):
    df = spark.createDataFrame([([0.8, 0.9], [0.7, 0.7], "hé"), ([], [], "")], "m array<double>, f array<double>, t string")
    rows = df.select(M.motion_genres(F.col("m"), F.col("f")).alias("g"), M.rolling_hash(F.col("t")).alias("h")).collect()
    h = 0
    for b in "hé".encode():
        h = (h * 31 + b) % 2**32
    assert [[x["label"] for x in r["g"]] for r in rows] == [["Action"], []] and [r["h"] for r in rows] == [h, 0]


def test_search_plan_is_exact_for_high_recall():
    assert {choose(rows, 10, target) for rows in (1000, 10**7, 10**12) for target in (0.96, 0.99, 1.0)} == {"exact"}


def test_search_plan():
    assert choose(1000, 10, 0.95) == "exact" and choose(10**9, 10, 0.95) == "lsh" and choose(10**9, 10, 0.5) == "pq"


def test_consolidation_follows_the_greedy_order(spark):
    from skein.operators.vectors import consolidate

    v = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i % 2, i, v[i].tolist()) for i in range(40)], "g int, id int, v array<double>")
    got = {(r["group"], r["leader"], r["id"]) for r in consolidate(df, "g", "id", "v", 0.5, 20).collect()}
    u, want = v / np.linalg.norm(v, axis=1, keepdims=True), set()
    for g in range(2):
        left = [i for i in range(40) if i % 2 == g]
        while left:
            mine = [i for i in left if i == left[0] or u[i] @ u[left[0]] > 0.5]
            want |= {(g, left[0], i) for i in mine}
            left = [i for i in left if i not in mine]
    assert got == want
