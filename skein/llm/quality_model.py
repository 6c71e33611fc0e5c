"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a whole text (never its label, language, source or id) are
standardised and mapped to cosines of random projections, which approximate a
Gaussian kernel. Ridge weights come from normal equations summed in each
partition and then over partitions, row by row of the matrix. Raw scores of the
training rows, in a fixed number of bins, give an isotonic map to probabilities.

Training rows are the labelled rows that the caller allows, at most about
``MAX_TRAIN`` of them, taken by a hash of the id where there are more; everything
else reads all rows.

Defined results: a null or empty text has statistics of zero and a score like any
other; repeated rows score alike; null labels teach nothing; without any label of
some value each score is the share of ones (0.5 without labels); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.scratch import materialise

MAX_TRAIN = 200_000
FEATURES, GAMMA, RIDGE, SEED, BINS = 192, 0.05, 1e-3, 11, 2000
STATISTICS = (
    "words", "chars", "word_length", "length_spread", "upper", "digits", "symbols", "bars", "marks", "stops",
    "distinct", "top_word", "echoes", "short", "long", "dup_lines", "dup_sentences", "no_words",
)


def statistics(text: str | None) -> list[float]:
    """The numbers that describe one text, in the order of ``STATISTICS``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (len(STATISTICS) - 1) + [1.0]
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda x: int(octets[list(x)].sum()) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    sentences = text.split(". ")
    return [
        math.log1p(n), math.log1p(size), float(lengths.mean()), float(lengths.std()), of(range(65, 91)), of(range(48, 58)),
        of(b"#$%&*<>@^~=+"), of(b"|"), of(b"!?"), of(b".,;:"), math.log(len(counts) + 1) / math.log(n + 1), max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(sentences)) / len(sentences), 0.0,
    ]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, stats)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, stats array<double>")


def remainder(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 4."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))


class Model:
    """A fitted model: standardisation, projections, weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED, width: int = FEATURES, gamma: float = GAMMA):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, math.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * math.pi, width)
        self.beta = np.zeros(width + 1)
        self.blend = 0.0  # until weights are fitted
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant; standard scores are held within 6."""
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of the raw score keeps equal steps in order."""
        raw = self.raw(stats)
        return np.clip((1 - self.blend) * np.interp(raw, *self.knots) + self.blend * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y. A partition emits one row of sums for each row of the matrix; equal rows are then added."""
    d, k = len(model.b) + 1, len(STATISTICS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                z = model.features(_matrix(piece.column("stats"), k))
                total[:, :d] += z.T @ z
                total[:, d] += z.T @ piece.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("sums").combine_chunks()
        return pa.table({"i": table.column("i")[:1], "sums": pa.array([_matrix(rows, d + 1).sum(0)], pa.list_(pa.float64()))})

    parts = train.select("stats", "y").mapInArrow(part, "i int, sums array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i int, sums array<double>").collect()
    total = np.zeros((d, d + 1))
    for i, sums in rows:
        total[i] = sums
    return total[:, :d], total[:, d]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", allow: Column | None = None, max_train: int = MAX_TRAIN) -> Model:
    """Fit to the labelled rows for which ``allow`` (over ``doc_id``) holds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    if allow is not None:
        known = known.where(allow)
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_train / n))
    train = materialise(described.join(known, "doc_id"), "train")
    k = len(STATISTICS)
    moments = train.agg(F.count("*"), F.avg("y"), *[f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return Model(np.zeros(k), np.ones(k))
    model = Model(np.array(moments[2::2], float), np.array(moments[3::2], float))
    share = float(moments[1])
    if share in (0.0, 1.0):
        model.knots = (np.array([0.0, 1.0]), np.array([share, share]))
        return model
    a, b = _equations(train, model)
    ridge = RIDGE * moments[0] / len(model.b) * np.eye(len(b))
    ridge[-1, -1] = 0
    model.beta, model.blend = np.linalg.solve(a + ridge, b), 0.01

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(model.raw(_matrix(x.column("stats"), k)), -0.5, 1.5)), x.column("y")], ["raw", "y"])

    bins = train.select("stats", "y").mapInArrow(scored, "raw double, y double").groupBy(F.floor((F.col("raw") + 0.5) * (BINS / 2)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    rows = bins.orderBy("x").collect()
    model.knots = isotonic(*[np.array([float(r[c]) for r in rows]) for c in ("x", "y", "n")])
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every described row."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("stats"), k)))], ["doc_id", "score"])

    return described.mapInArrow(run, f"doc_id {described.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; labels of held-out ids are never read."""
    described = materialise(describe(docs, id_col, text_col), "described")
    model = fit(described, labels, id_col, label_col, remainder("doc_id") != held_out)
    scored = score(described, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
