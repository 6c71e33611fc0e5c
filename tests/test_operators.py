"""Operators that SQL does not cover, on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import aggregates, filters, graph, indexes, ranking, sequential, vectors
from skein.operators.provenance import merkle_roots
from skein.sources import formats
from skein.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_missing_fields_in_filters(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}"), (3, None)], "id int, meta string")
    ids = lambda spec: [r.id for r in df.where(filters.compile_filter(spec, filters.json_field("meta"))).orderBy("id").collect()]
    assert ids({"a": {"$ne": "1"}}) == [2, 3] and ids({"a": {"$nin": ["1"]}}) == [2, 3]
    assert ids({"a": {"$gt": "0"}}) == [1] and ids({"a": {"$exists": False}}) == [2, 3]
    assert ids({"a": {"$what": 1}}) == [] and ids({}) == [1, 2, 3]
    with pytest.raises(TypeError):
        filters.compile_filter({"a": {"$in": 3}})


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([2.0, 0.0, 0.0], [5.0, 0.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine("a", "b")).collect()] == [0, 0, 1]


def test_weighted_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1.0), (1, [0.0, 1.0], 0.5), (2, [1.0, 1.0], 0.0)], "u int, v array<double>, w double")
    got = {r.u: r.vector for r in aggregates.mean_vector(df, "u", "v", F.col("w")).collect()}
    assert np.allclose(got[1], [2 / 3, 1 / 3]) and got[2] is None


def test_formulas(spark):
    row = spark.range(1).select(
        S.doubly_robust(F.lit(0.6), F.lit(0.5), F.lit(0.8), F.lit(0.5)), S.ucb1(F.lit(0.5), F.lit(1), F.lit(1)), S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), S.jaccard(F.array().cast("array<int>"), F.array(F.lit(1)))
    ).first()
    assert [round(x, 6) for x in row] == [0.5, 0.5, 0.333333, 0.0]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1, False, 1), (1, 2, True, 1), (2, 1, False, 0), (2, 2, False, 0)], "query int, rank int, relevant boolean, n_relevant int")
    got = {r["query"]: r for r in ranking.evaluate(df, 2).collect()}
    assert round(got[1].ndcg, 4) == 0.6309 and got[1].mrr == 0.5 and got[2].ndcg == 0.0


def test_mmr_spreads(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.01]), (1, 3, 0.5, [0.0, 1.0])]
    picked = ranking.mmr(spark.createDataFrame(rows, "query long, id long, score double, v array<double>"), 2, 0.5).orderBy("position").collect()
    assert [r.id for r in picked] == [1, 3]


def test_batch_search_equals_numpy(spark):
    e = table(spark, DATA, "embeddings")
    rows = e.orderBy("vec_id").limit(200).collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    part = spark.createDataFrame(rows, e.schema)
    got = ranking.knn_batch(part, part.where("vec_id < 5"), "vec_id", "embedding", 3, block=2).collect()
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    for q in range(5):
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rank)] == np.argsort(-sims[q])[:3].tolist()


def test_index_recall(spark):
    e = table(spark, DATA, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    exact = ranking.knn_batch(e, asked, "vec_id", "embedding", 10)
    assert indexes.recall(indexes.lsh_search(e, asked, "vec_id", "embedding", 64, 10, tables=40, bits=5), exact, 10) >= 0.9
    assert indexes.recall(exact, exact, 10) == 1.0


def test_merkle(spark):
    import hashlib

    h = [hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c")]
    s = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(h)], "k int, i int, h string")
    assert merkle_roots(df, "k", "i", "h").first().root == s(s(h[0] + h[1]) + h[2])


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    assert {(r.node, r.dist) for r in graph.shortest(e, spark.createDataFrame([("a",)], "n string")).collect()} == {("a", 0.0), ("b", 1.0), ("c", 2.0)}
    assert {(r.component, r.node) for r in graph.cycles(graph.closure(e)).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    assert len(graph.paths(e, spark.createDataFrame([("a",)], "n string"), 3).collect()) == 3


def test_ordered_operators(spark):
    steps = spark.createDataFrame([(1, 1, "s", "x", 1.0, "t"), (1, 2, "t", "y", 2.0, None), (1, 3, "s", "x", 0.0, "t")], "session long, at long, state string, action string, reward double, next_state string")
    got = {(r.state, r.action): round(r.q, 6) for r in sequential.q_learning(steps, 0.5, 0.9).collect()}
    assert got == {("s", "x"): 0.7, ("t", "y"): 1.0}
    cover = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (1, 3, "c")], "query long, chunk long, requirement string")
    assert [r.chunk for r in sequential.hitting_set(cover).orderBy("step").collect()] == [2, 3]
    ballots = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b", "a"]), (4, ["c", "b"]), (5, ["b", "c"])], "voter int, choices array<string>")
    rounds = sequential.instant_runoff(ballots)
    assert (1, "c", 1, True) in rounds and (2, "b", 3, False) in rounds


def test_bandit_equals_fold(spark):
    values = [0.3, 0.9, 0.1, 0.5, 0.5]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, at int, r double")
    mean, spread = 0.0, 1.0
    for n, v in enumerate(values, 1):
        spread = 0.9 * spread + 0.1 * abs(v - mean)
        mean += (v - mean) / n
    row = sequential.bandit(df, "k", ["at"], "r").first()
    assert (row.n, round(row["mean"], 9), round(row.spread, 9)) == (5, round(mean, 9), round(spread, 9))


def test_skyline(spark):
    rows = [(1, 3.0, 5.0), (2, 3.0, 5.0), (3, 2.0, 4.0), (4, 2.0, 6.0), (5, 1.0, 4.0), (6, 0.5, 1.0), (7, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, r double, l double").repartition(3)
    assert {r.id for r in ranking.skyline(df, "r", "l").collect()} == {1, 2, 3, 6}


def test_turtle():
    text = '@prefix x: <http://x/> .\n# note\nx:a a x:Class ; x:label "A; b"@en , "B" .\n<http://y#z> x:sub x:a .'
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert list(formats.parse_turtle(text)) == [("http://x/a", rdf, "http://x/Class"), ("http://x/a", "http://x/label", "A; b"), ("http://x/a", "http://x/label", "B"), ("http://y#z", "http://x/sub", "http://x/a")]
