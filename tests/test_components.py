from skein.operators.components import connected_components


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 230)] + [(3, 3), (5, 9), (9, 5), (229, 120)]
    df = spark.createDataFrame(edges + [(None, 4)], "src long, dst long")
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
