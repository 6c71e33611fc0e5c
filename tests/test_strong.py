"""Strong components without the closure."""

import random

from skein import queries as core
from skein.operators import graph


def _brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in reach[n]:
                    reach[n].add(b)
                    todo.append(b)
    return {(min(mates), n) for n in nodes for mates in [{m for m in nodes if m != n and m in reach[n] and n in reach[m]} | {n}] if len(mates) > 1}


def test_strong_components_in_pieces_and_in_rounds(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40) + 100 * c, rng.randrange(40) + 100 * c) for c in range(3) for _ in range(45)}
    edges |= {(1000 + i, 1000 + (i + 1) % 12) for i in range(12)} | {(2000 + i, 2001 + i) for i in range(5)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    want = _brute(edges)
    assert len(want) > 12
    for whole in (graph.WHOLE, 30, 0):
        assert {(r.component, r.node) for r in graph.strong_components(df, whole=whole).collect()} == want
    assert graph.strong_components(df.where("src < 0")).collect() == []


def test_cycles_of_parts_build_no_closure(spark, monkeypatch):
    """The closure has up to 97 rows for each part, and its last rounds join it with itself."""
    monkeypatch.setattr(graph, "closure", None)
    assert core.QUERIES["o_cycles"](spark, "/root/testdata/sf0.001").count() > 0
