"""Ranking, diversification, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.scratch import materialise


def knn_batch(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, block: int = 16_384) -> DataFrame:
    """``(query, id, score, rank)``: exact cosine top-k of each query over the whole corpus.

    Queries are taken in blocks of at most ``block`` vectors, so what is sent to the
    tasks is bounded; a block is one scan, and its rows are stored before the next block
    is read. Each task multiplies matrices and keeps k rows per query of each batch, and
    a window over these picks the final ones.
    """
    found = _in_blocks(corpus, queries, id_col, vec_col, block, lambda scores, own: _best(scores, own, k))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, least: float, once: bool = False, block: int = 16_384) -> DataFrame:
    """``(query, id, score)``: every row whose cosine with a query is ``least`` or more; with ``once`` only those of greater id.

    The same scans as ``knn_batch``: only pairs over the threshold leave a task.
    """
    found = _in_blocks(corpus, queries, id_col, vec_col, block, lambda scores, own: np.nonzero(scores >= least))
    return found.where("query < id") if once else found


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest scores of each row; ties at the edge go to the least id, as in the final window."""
    rounded = np.round(scores, 12)
    n = rounded.shape[1]
    if n > k:
        edge = np.partition(rounded, n - k, axis=1)[:, n - k, None]
        rows, columns = np.nonzero(rounded >= edge)
    else:
        rows, columns = np.indices(rounded.shape).reshape(2, -1)
    order = np.lexsort((own[columns], -rounded[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], columns[keep]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without a Python object for each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


#: Queries whose scores against a batch are held at once.
_TOGETHER = 512
_SCORED = "query long, id long, score double"


def _in_blocks(corpus: DataFrame, queries: DataFrame, id_col: str, vec_col: str, block: int, pick: Callable, meets: Callable | None = None) -> DataFrame:
    held, last, stored = [], None, None
    for row in queries.select(F.col(id_col), F.col(vec_col)).where(F.col(vec_col).isNotNull()).toLocalIterator():
        held.append((row[0], list(row[1])))
        if len(held) == block:
            done = materialise(_scan(corpus, held, id_col, vec_col, pick, meets), "neighbours")
            stored, held = done if stored is None else stored.unionByName(done), []
    if held:
        last = _scan(corpus, held, id_col, vec_col, pick, meets)
    if last is None:
        return stored if stored is not None else corpus.sparkSession.createDataFrame([], _SCORED)
    return last if stored is None else stored.unionByName(last)


def _scan(corpus: DataFrame, held: list, id_col: str, vec_col: str, pick: Callable, meets: Callable | None = None) -> DataFrame:
    """Pairs that ``pick`` takes. ``meets`` gets a batch's vectors and gives, for some queries' vectors, which pairs count at all."""
    ids, raw = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], float)
    q = _unit(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, vectors = b.column("id").to_numpy(), matrix(b.column("v"))
            unit, meet = _unit(vectors).T, meets(vectors) if meets else None
            for at in range(0, len(ids), _TOGETHER):
                asked = ids[at : at + _TOGETHER]
                scores = q[at : at + _TOGETHER] @ unit
                scores[asked[:, None] == own[None, :]] = -np.inf
                if meet:
                    scores[~meet(raw[at : at + _TOGETHER])] = -np.inf
                rows, columns = pick(scores, own)
                found = np.isfinite(scores[rows, columns])
                rows, columns = rows[found], columns[found]
                yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(own[columns]), pa.array(scores[rows, columns])], ["query", "id", "score"])

    return corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").mapInArrow(run, _SCORED)


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """``(query, id, position)``: greedy maximal marginal relevance of each query's candidates ``(query, id, score, v)``.

    Candidate sets are top-k lists, a bounded number of rows per query.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v, score = _unit(np.array(pdf["v"].tolist(), float)), pdf["score"].to_numpy()
        chosen: list[int] = []
        near = np.full(len(pdf), -np.inf)
        while len(chosen) < min(k, len(pdf)):
            gain = weight * score - (1 - weight) * (near if chosen else 0)
            gain[chosen] = -np.inf
            i = int(np.argmax(gain))
            chosen.append(i)
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"query": pdf["query"].iloc[0], "id": pdf["id"].iloc[chosen].to_numpy(), "position": np.arange(1, len(chosen) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, "query long, id long, position long")


def evaluate(ranked: DataFrame, k: int) -> DataFrame:
    """``(query, precision, mrr, ndcg)`` at ``k`` of ``(query, rank, relevant, n_relevant)`` rows."""
    top = ranked.where(F.col("rank") <= k)
    rel = F.col("relevant").cast("double")
    dcg = F.sum(rel / F.log2(F.col("rank") + 1))
    n = F.least(F.max("n_relevant"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    g = top.groupBy("query").agg((F.sum(rel) / k).alias("precision"), F.coalesce(1 / F.min(F.when(rel > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"), dcg.alias("d"), n.alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return g.select("query", "precision", "mrr", F.when(F.col("n") > 0, F.col("d") / ideal).otherwise(0.0).alias("ndcg"))


def skyline(df: DataFrame, high: str, low: str) -> DataFrame:
    """Rows that no other row beats in one of a high and a low measure without losing in the other.

    Batches are thinned to their own skylines where they lie; only these few rows meet
    in the ordered pass, and rows that tie with a point of the skyline stay.
    """
    points = df.where(F.col(high).isNotNull() & F.col(low).isNotNull()).select(F.col(high).cast("double").alias("h"), F.col(low).cast("double").alias("l"))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["h", "l"], ascending=[False, True])
            before = b["l"].cummin().shift(fill_value=np.inf)
            yield b[b["l"] < before]

    best = points.mapInPandas(thin, "h double, l double").groupBy("h").agg(F.min("l").alias("l"))
    w = Window.orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("before", F.min("l").over(w)).where("before is null or l < before").select(F.col("h").alias("__h"), F.col("l").alias("__l"))
    return df.join(front, (F.col(high).cast("double") == F.col("__h")) & (F.col(low).cast("double") == F.col("__l")), "left_semi")


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """``(query, recall)`` at ``k`` of ``(query, rank, relevant, n_relevant)`` rows; 0 where nothing is relevant."""
    hits = F.sum(F.when((F.col("rank") <= k) & F.col("relevant"), 1.0).otherwise(0.0))
    return ranked.groupBy("query").agg(hits.alias("h"), F.max("n_relevant").alias("n")).select("query", F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0).alias("recall"))


def rerank(results: DataFrame, by: Column, k: int, share: float = 0.7) -> DataFrame:
    """The ``k`` best of each query after ``score`` becomes ``share`` of itself plus the rest of the expression ``by``."""
    scored = results.withColumn("score", share * F.col("score") + (1 - share) * by).drop("rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def attention_scores(candidates: DataFrame, dims: int, context: list[float] | None = None, share: float = 0.3) -> DataFrame:
    """``(query, id, score)`` of ``(query, id, q, v)`` candidates: the query, with ``share`` of the context added, attends to its candidates, and each is scored against what comes out.

    Projections are the identity; candidates are top-k lists, a bounded number of rows per query.
    """
    from skein.operators.attention import attend
    from skein.operators.vectors import dot

    added = F.array(*[F.lit(share * float(x)) for x in [*(context or []), *[0.0] * dims][:dims]])
    asked = F.zip_with(F.col("q").cast("array<double>"), added, lambda a, b: a + b)
    out = attend(candidates.select("query", asked.alias("q"), F.col("v").cast("array<double>").alias("k"), F.col("v").cast("array<double>").alias("x")), dims)
    return candidates.join(out.withColumnRenamed("v", "attended"), "query").select("query", "id", dot("attended", "v").alias("score"))


def enhance(neighbours: DataFrame, dims: int, share: float = 0.5) -> DataFrame:
    """``(query, v)`` of ``(query, q, v, weight)``: unit vector of the query's share and the weighted mean of its neighbours; negative weights count as 0, and a query without weight stays."""
    from skein.operators.vectors import unit

    w = F.greatest(F.col("weight"), F.lit(0.0))
    g = neighbours.groupBy("query").agg(F.first("q").alias("q"), F.sum(w).alias("w"), *[F.sum(w * F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dims)])
    mixed = F.array(*[(1 - share) * F.get("q", F.lit(i)).cast("double") + F.coalesce(share * F.try_divide(f"s{i}", "w"), F.lit(0.0)) for i in range(dims)])
    return g.select("query", unit(F.when(F.col("w") > 0, mixed).otherwise(F.col("q").cast("array<double>"))).alias("v"))


class KnnPipeline:
    """A search put together step by step: ``KnnPipeline(df, id, vec).k(5).at_least(0.1).search(vector)``."""

    def __init__(self, corpus: DataFrame, id_col: str, vec_col: str):
        self.corpus, self.id_col, self.vec_col, self._k, self._least, self._where = corpus, id_col, vec_col, 10, None, None

    def k(self, k: int) -> KnnPipeline:
        self._k = k
        return self

    def at_least(self, score: float) -> KnnPipeline:
        self._least = score
        return self

    def where(self, condition: Column) -> KnnPipeline:
        self._where = condition
        return self

    def _rows(self) -> DataFrame:
        return self.corpus if self._where is None else self.corpus.where(self._where)

    def search(self, vector: list[float]) -> DataFrame:
        """``(id, score)`` of one vector's neighbours."""
        from skein.operators.vectors import knn

        return knn(self._rows(), vector, self.id_col, self.vec_col, self._k, threshold=self._least).select(F.col(self.id_col).alias("id"), "score")

    def batch(self, queries: DataFrame) -> DataFrame:
        """``(query, id, score, rank)`` of every row of ``queries``."""
        found = knn_batch(self._rows(), queries, self.id_col, self.vec_col, self._k)
        return found if self._least is None else found.where(F.col("score") >= self._least)
