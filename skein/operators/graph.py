"""Graphs over edge tables: bounded paths, shortest distances, closure, communities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.components import connected_components
from skein.operators.vectors import knn, l2
from skein.plans.scratch import discard, materialise


def paths(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """``(start, node, hops, cost, path)``: simple paths of 1 to ``depth`` hops. No node comes twice in a path, by membership in it."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("t"), F.col(weight).alias("c"))
    step = start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node"), F.lit(0).alias("hops"), F.lit(0.0).alias("cost"), F.array(start.columns[0]).alias("path"))
    out = None
    for _ in range(depth):
        step = step.join(e, F.col("node") == F.col("s")).where(~F.array_contains(F.col("path"), F.col("t")))
        step = step.select("start", F.col("t").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("path", F.array("t")).alias("path"))
        out = step if out is None else out.unionByName(step)
    return out


def shortest(edges: DataFrame, sources: DataFrame, max_hops: int = 10_000, bound: float | None = None, steps: int | None = None) -> DataFrame:
    """``(source, node, dist)`` by relaxing all edges until nothing improves; distances over ``bound`` are left out.

    With ``steps`` the walk ends after so many hops; without it, one that has not settled in ``max_hops`` raises.
    """
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("weight").alias("c"))
    dist = materialise(sources.select(F.col(sources.columns[0]).alias("source"), F.col(sources.columns[0]).alias("node"), F.lit(0.0).alias("dist")), "sssp")
    front, held = dist, None
    for _ in range(max_hops if steps is None else steps):
        step = front.join(e, F.col("node") == F.col("s")).groupBy("source", F.col("t").alias("node")).agg(F.min(F.col("dist") + F.col("c")).alias("new"))
        if bound is not None:
            step = step.where(F.col("new") <= bound)
        both = materialise(dist.join(step, ["source", "node"], "full_outer").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better")), "sssp")
        if held is not None:
            discard(held)
        held, dist, front = both, both.select("source", "node", "dist"), both.where("better").select("source", "node", "dist")
        if front.isEmpty():
            return dist
    if steps is not None:
        return dist
    raise RuntimeError(f"distances did not settle in {max_hops} hops")


def closure(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """``(src, dst)``: all pairs joined by a path, by doubling until no pair is new."""
    pairs = materialise(edges.select("src", "dst").distinct(), "closure")
    n = pairs.count()
    for _ in range(max_rounds):
        longer = pairs.join(pairs.select(F.col("src").alias("m"), F.col("dst").alias("d")), F.col("dst") == F.col("m")).select("src", F.col("d").alias("dst"))
        old, pairs = pairs, materialise(pairs.unionByName(longer).distinct(), "closure")
        discard(old)
        now = pairs.count()
        if now == n:
            return pairs
        n = now
    raise RuntimeError("closure did not settle")


def lineage(parents: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(start, node, depth)``: each start and its ancestors over ``(src, dst)``, each by its least depth; a node is met once, so cycles end."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    front = seen
    for depth in range(1, max_rounds + 1):
        step = front.join(parents.select("src", "dst"), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "lineage")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"lineage did not end in {max_rounds} rounds")


def cycles(closed: DataFrame) -> DataFrame:
    """``(component, node)`` of cycles: nodes that reach each other, named by the least."""
    back = closed.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    both = closed.join(back, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))).where("src <> dst")
    return both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")).select("component", "node")


#: Edges of a weak component that a task takes as a whole.
WHOLE = 200_000


def strong_components(edges: DataFrame, max_rounds: int = 1000, whole: int = WHOLE) -> DataFrame:
    """``(component, node)`` as ``cycles`` gives it, without the closure: nodes that reach each other, named by the least.

    Weak components of at most ``whole`` edges are searched in one piece each, many to a
    task; larger ones by rounds over all their edges, where no task holds one of them.
    """
    e = materialise(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    weak = connected_components(e)
    held = materialise(e.join(weak, F.col("src") == F.col("node")).select("component", "src", "dst"), "held")
    large = materialise(held.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("component"), "large")
    small = held if large.isEmpty() else held.join(large, "component", "left_anti")
    found = small.repartition("component").sortWithinPartitions("component").mapInArrow(_strong_pieces, "component long, node long")
    if large.isEmpty():
        return found
    return found.unionByName(_strong_rounds(held.join(large, "component", "left_semi").select("src", "dst"), max_rounds))


def _strong_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strong components of edges sorted by weak component; the last one is held until it ends."""
    held, waiting, size = None, [], 0

    def found(rows: np.ndarray) -> pa.RecordBatch:
        component, node = strongly_connected(rows[1], rows[2])
        return pa.RecordBatch.from_arrays([pa.array(component), pa.array(node)], ["component", "node"])

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(np.array([b.column(c).to_numpy() for c in ("component", "src", "dst")], np.int64))
        size += b.num_rows
        if size < 2 * (held or 1):  # a component that goes on is looked at again only when as much has come
            continue
        rows = np.hstack(waiting)
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        if cut:
            yield found(rows[:, :cut])
        waiting, size = [rows[:, cut:]], rows.shape[1] - cut
        held = size
    if waiting:
        yield found(np.hstack(waiting))


def strongly_connected(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(component, node)`` of the nodes in strong components of two or more, by Tarjan's search without recursion."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    order = np.argsort(a, kind="stable")
    at, ahead = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist()
    seen, low, of, stack, count = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes), [], 0
    following = at[:-1]
    for root in range(len(nodes)):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                stack.append(v)
            if following[v] < at[v + 1]:
                w = ahead[following[v]]
                following[v] += 1
                if seen[w] < 0:
                    path.append(w)
                elif of[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                piece = [stack.pop()]
                while piece[-1] != v:
                    piece.append(stack.pop())
                least = min(piece)
                for w in piece:
                    of[w] = least if len(piece) > 1 else len(nodes)
    of = np.array(of, np.int64)
    kept = np.flatnonzero(of < len(nodes))
    return nodes[of[kept]], nodes[kept]


def _strong_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Strong components by colours: of the nodes that a least node reaches, those that reach it back; the others go on without them."""
    left, out, rounds = materialise(edges.select("src", "dst").distinct(), "edges"), None, 0

    def spread(marked: DataFrame, along: DataFrame) -> DataFrame:
        """Least mark of each node or of one before it, until nothing changes."""
        nonlocal rounds
        before = None
        while True:
            now = marked.agg(F.count("*"), F.sum(F.col("mark").cast("decimal(38,0)"))).first()
            if now == before:
                return marked
            before, rounds = now, rounds + 1
            if rounds > max_rounds:
                raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
            sent = along.join(marked, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "mark")
            marked = materialise(marked.unionByName(sent).groupBy("node").agg(F.min("mark").alias("mark")), "marks")

    def trimmed(left: DataFrame) -> DataFrame:
        """Edges without those whose ends have no way in or no way out, over and over."""
        nonlocal rounds
        n = left.count()
        while n:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
            ins, outs = left.select(F.col("dst").alias("into")).distinct(), left.select(F.col("src").alias("from")).distinct()
            left = materialise(left.join(ins, F.col("src") == F.col("into"), "left_semi").join(outs, F.col("dst") == F.col("from"), "left_semi"), "edges")
            n, old = left.count(), n
            if n == old:
                break
        return left

    left = trimmed(left)
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = spread(nodes.withColumn("mark", F.col("node")), left)
        a, b = colour.select(F.col("node").alias("src"), F.col("mark").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("mark").alias("cb"))
        inside = materialise(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"), "edges")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        met = spread(colour.where("node = mark").select("node", "mark"), back)
        joined = met.join(met.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "mark").select(F.col("mark").alias("component"), "node")
        out = joined if out is None else out.unionByName(joined)
        gone = met.select("node")
        left = inside.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
        left = trimmed(materialise(left, "edges"))
    return out if out is not None else edges.select(F.col("src").alias("component"), F.col("dst").alias("node")).where("false")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, label)`` after synchronous rounds: the commonest label among neighbours, ties to the least."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        old, labels = labels, materialise(votes.groupBy(F.col("src").alias("node")).agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("k"))).alias("label")), "labels")
        discard(old)
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Standard modularity of a labelling of an undirected edge list, one row."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.array("la", "lb")).alias("label")).groupBy("label").agg(F.count("*").alias("k"))
    inside = e.groupBy(F.col("la").alias("label")).agg(F.sum((F.col("la") == F.col("lb")).cast("int")).alias("i"))
    m = e.count() or 1
    return ends.join(inside, "label", "left").agg(F.sum(F.coalesce("i", F.lit(0)) / m - F.pow(F.col("k") / (2.0 * m), F.lit(2))).alias("q"))


def top_per(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_moves(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """``(node, label)``: each node moves to the neighbouring community with the greatest modularity gain, in synchronous rounds.

    The gain is links to the community less its degree share. A node moves only to a lesser label in odd rounds and a
    greater one in even rounds, so two nodes never swap for ever.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    total = float(both.count() or 1)
    labels = degree.withColumn("label", F.col("node"))
    for r in range(rounds):
        size = labels.groupBy("label").agg(F.sum("k").alias("size"))
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("inside"))
        own = labels.select("node", "k", F.col("label").alias("old"))
        stay = own.select("node", F.col("old").alias("label"), F.lit(0).cast("long").alias("inside"))
        votes = near.unionByName(stay).groupBy("node", "label").agg(F.sum("inside").alias("inside")).join(size, "label").join(own, "node")
        rest = F.col("size") - F.when(F.col("label") == F.col("old"), F.col("k")).otherwise(0)
        ahead = F.col("label") <= F.col("old") if r % 2 == 0 else F.col("label") >= F.col("old")
        gain = F.struct((F.col("inside") - F.col("k") * rest / total).alias("g"), (-F.col("label")).alias("low"))
        before, labels = labels, materialise(votes.where(ahead).groupBy("node").agg(F.max_by("label", gain).alias("label"), F.first("k").alias("k")), "moves")
        discard(before)
    return labels.select("node", "label")


def refine(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, label)``: each community split into its connected parts, named by the least node; every community is then connected."""
    named = labels.select("node", "label")
    a, b = named.select(F.col("node").alias("src"), F.col("label").alias("la")), named.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    inside = edges.select("src", "dst").where("src <> dst").join(a, "src").join(b, "dst").where("la = lb")
    parts = connected_components(inside)
    return named.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def leiden(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """``(node, label)``: communities by local moves, refined so that each is connected."""
    return refine(edges, local_moves(edges, rounds))


def spectral(edges: DataFrame, k: int, rounds: int = 30, seed: int = 3) -> DataFrame:
    """``(node, label)``: k-means over the leading ``k`` eigenvectors of the normalised adjacency with self loops.

    Orthogonal iteration: a round is one join and one aggregate over the edges; the ``k`` by
    ``k`` matrix of inner products goes to the driver and its inverse root back as literals.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    degree = both.groupBy(F.col("src").alias("node")).agg((F.count("*") + 1).alias("d"))
    nodes = materialise(degree, "degrees")
    links = both.join(nodes.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    links = materialise(links.select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")), "normalised")
    draw = [F.xxhash64("node", F.lit(seed), F.lit(i)).cast("double") / float(2**63) for i in range(k)]
    at = nodes.select("node", "d", F.array(*draw).alias("v"))
    for _ in range(rounds):
        at = materialise(_orthonormal(at, k), "spectral")
        sums = links.join(at.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(k)])
        # half of the old vector keeps the iteration at the positive end of the spectrum
        at = at.join(sums, "node").select("node", "d", F.array(*[0.5 * F.get("v", F.lit(i)) + 0.5 * (F.get("v", F.lit(i)) / F.col("d") + F.col(f"s{i}")) for i in range(k)]).alias("v"))
    at = materialise(_orthonormal(at, k), "spectral")
    length = F.sqrt(F.aggregate("v", F.lit(1e-300), lambda s, x: s + x * x))
    rows = at.select("node", array_to_vector(F.transform("v", lambda x: x / length)).alias("features"))
    fitted = KMeans(k=k, seed=seed).fit(rows)
    return fitted.transform(rows).select("node", F.col("prediction").cast("long").alias("label"))


def _orthonormal(at: DataFrame, k: int) -> DataFrame:
    """The vectors times the inverse Cholesky factor of their inner products."""
    sums = [F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))) for i in range(k) for j in range(k)]
    gram = np.array(at.agg(*sums).first(), float).reshape(k, k)
    turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.eye(k))).T
    columns = [sum((F.get("v", F.lit(i)) * float(turn[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k)]
    return at.select("node", "d", F.array(*columns).alias("v"))


def choose_paths(nodes: int, edges: int, large: int = 10_000_000, sparse_from: int = 100_000) -> str:
    """Plan for shortest distances: landmarks for very large graphs and for sparse ones (mean degree under the log of the nodes) of some size, else relaxation."""
    sparse = nodes > 0 and edges / nodes < math.log2(nodes)
    return "landmarks" if nodes > large or (sparse and nodes > sparse_from) else "relax"


def nearest_pivots(frontier: DataFrame, pivots: DataFrame, parts: int) -> DataFrame:
    """``(node, part)``: each node of ``(node, dist)`` goes to the pivot of nearest distance, ties to the first, and a pivot's part is its place modulo ``parts``.

    Pivots ``(place, dist)`` are a short list (a stated number of them) that goes to every task.
    """
    gap = F.struct(F.abs(F.col("dist") - F.col("pd")).alias("gap"), F.col("place"))
    near = frontier.crossJoin(F.broadcast(pivots.select("place", F.col("dist").alias("pd")))).groupBy("node").agg(F.min(gap).alias("g"))
    return near.select("node", (F.col("g.place") % parts).alias("part"))


def greedy_walks(edges: DataFrame, nodes: DataFrame, queries: DataFrame, start, most: int = 50) -> DataFrame:
    """``(query, node, hops)``: where each walk from ``start`` ends that hops to the neighbour nearest to its query while that is nearer.

    A round moves all walks by one join over the edges; distances fall, so no node is met twice.
    """
    v = nodes.select(F.col("node").alias("at"), F.col("v").alias("av"))
    walks = queries.select("query", "q", F.lit(start).cast("long").alias("node")).join(v, F.col("node") == F.col("at")).select("query", "q", "node", l2("q", "av").alias("gap"), F.lit(0).alias("hops"), F.lit(True).alias("moves"))
    walks = materialise(walks, "walks")
    for hop in range(1, most + 1):
        near = walks.where("moves").join(edges.select("src", "dst"), F.col("node") == F.col("src")).join(v, F.col("dst") == F.col("at")).select(F.col("query").alias("of"), "dst", "gap", l2("q", "av").alias("new")).where("new < gap")
        best = near.groupBy("of").agg(F.min(F.struct("new", "dst")).alias("b"))
        j = walks.join(best, F.col("query") == F.col("of"), "left")
        moved = F.col("b").isNotNull()
        old, walks = walks, materialise(j.select("query", "q", F.when(moved, F.col("b.dst")).otherwise(F.col("node")).alias("node"), F.when(moved, F.col("b.new")).otherwise(F.col("gap")).alias("gap"), F.when(moved, F.lit(hop)).otherwise(F.col("hops")).alias("hops"), moved.alias("moves")), "walks")
        discard(old)
        if walks.where("moves").isEmpty():
            break
    return walks.select("query", "node", "hops")


class GraphStore:
    """Nodes ``(node, v, ...)`` and edges ``(src, dst, weight)`` behind one interface."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def traverse(self, start, depth: int) -> DataFrame:
        """``(node, hops)`` of what is reached in 1 to ``depth`` steps, by the fewest; the start is left out."""
        e = self.edges.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct()
        seen = self.edges.sparkSession.createDataFrame([(start, 0)], f"node {self.edges.schema['src'].dataType.simpleString()}, hops int")
        front = seen
        for hop in range(1, depth + 1):
            step = front.join(e, F.col("node") == F.col("s")).select(F.col("t").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
            front = materialise(step.withColumn("hops", F.lit(hop)), "front")
            seen = seen.unionByName(front)
        return seen.where("hops > 0")

    def shortest_path(self, source, target) -> list:
        """The nodes of a cheapest path, ends included, or an empty list; ties go to the least node before."""
        spark = self.edges.sparkSession
        kind = self.edges.schema["src"].dataType.simpleString()
        dist = shortest(self.edges, spark.createDataFrame([(source,)], f"n {kind}"))
        path = [target]
        if dist.where(F.col("node") == target).isEmpty():
            return []
        while path[-1] != source:
            d = dist.where(F.col("node") == path[-1]).first()["dist"]
            near = self.edges.where(F.col("dst") == path[-1]).join(dist.select(F.col("node").alias("src"), "dist"), "src")
            path.append(near.where(F.abs(F.col("dist") + F.col("weight") - d) < 1e-9).agg(F.min("src")).first()[0])
        return path[::-1]

    def vector_search(self, query: list[float], k: int, context=None, depth: int = 2) -> DataFrame:
        """``(node, score)``: the ``k`` nodes most similar to a vector, with ``context`` only those within ``depth`` steps of it."""
        nodes = self.nodes if context is None else self.nodes.join(self.traverse(context, depth).select("node"), "node", "left_semi")
        return knn(nodes, query, "node", "v", k)
