"""Registered queries of the core library over the test tables, with their SQL."""

from __future__ import annotations

from skein.plans.registry import QUERIES, SQL
from skein.sources.tables import table
from skein.operators import vectors
from skein.plans.registry import query


@query(
    "knn_exact",
    """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
       select vec_id, label::bigint as label, round(list_cosine_similarity(embedding::double[], q), 6) as score
       from embeddings, q where vec_id <> 0
       order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 10""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    top = vectors.knn(e, vectors.vector_of(e, "vec_id", 0), "vec_id", "embedding", 10, exclude=0, keep=("label",))
    return top.selectExpr("vec_id", "cast(label as bigint) as label", "round(score, 6) as score")
