"""Text embeddings without a model, and search over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.vectors import cosine


def char_vector(text: str | None, dims: int) -> np.ndarray:
    """Unit vector of a text's characters: each UTF-16 unit adds a tenth of the sine of its tenth at its number plus its place; zeros for an empty text."""
    codes = np.frombuffer((text or "").lower().encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    v = np.bincount((codes + np.arange(len(codes))) % dims, np.sin(codes / 10) * 0.1, dims)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def embed(df: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """``(id, vector)`` of whole texts, batch by batch; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [char_vector(x.as_py(), dims) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "vector"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, vector array<double>")


def most_similar(df: DataFrame, text: str, id_col: str, text_col: str, k: int = 5, dims: int = 64) -> DataFrame:
    """``(id, similarity)``: the ``k`` texts nearest to ``text``, ties by id; one scan with a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in char_vector(text, dims)])
    return embed(df, id_col, text_col, dims).select("id", F.round(cosine("vector", q), 9).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)
