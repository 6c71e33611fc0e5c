"""Tools of the agent memory and media interfaces, one function each, over DataFrames.

Tables are passed in; nothing is looked up by name. Names and thresholds follow the tools
that callers know: inserting, searching and deleting memories, reflexion, skills, causal
edges, certificates, learning, patterns, media search and recommendations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import aggregates as A
from skein.operators import provenance as P
from skein.operators import sequential as Q
from skein.operators import vectors as V

# ---------------------------------------------------------------- functions of the schema


def state_hash(state: Column) -> Column:
    """SHA-256 of a state's text, for policies looked up by state."""
    return F.sha2(state.cast("binary"), 256)


def find_similar_episodes(episodes: DataFrame, vector: Sequence[float], task: str, k: int = 10, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` episodes of a task nearest to a vector, with ``similarity``."""
    return V.knn(episodes.where(F.col("task") == task), vector, id_col, vec_col, k).withColumnRenamed("score", "similarity")


def search_memories(memories: DataFrame, vector: Sequence[float], tenant, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """``(id, similarity)`` of a tenant's memories that are more similar than ``threshold``."""
    return V.knn(memories.where(F.col("tenant") == tenant), vector, "id", "embedding", k, threshold=threshold).where(F.col("score") > threshold).withColumnRenamed("score", "similarity")


def update_policies(episodes: DataFrame) -> DataFrame:
    """``(session_id, task, visits, mean, spread)``: the policy table after all rewards, folded in order."""
    keyed = episodes.withColumn("arm", F.struct("session_id", "task"))
    return Q.bandit(keyed, "arm", ["ts", "id"], "reward").select("arm.session_id", "arm.task", F.col("n").alias("visits"), "mean", "spread")


# ---------------------------------------------------------------- what triggers did


def touched(df: DataFrame, now: Column, changed: Column) -> DataFrame:
    """Set ``updated_at`` and ``last_used_at`` to ``now`` where a row has changed."""
    return df.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at"))).withColumn("last_used_at", F.when(changed, now).otherwise(F.col("last_used_at")))


def checked(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Add ``accepted``; a value outside the bounds is refused and becomes null. Null is refused as well."""
    ok = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return df.withColumn("accepted", ok).withColumn(column, F.when(ok, F.col(column)))


# ---------------------------------------------------------------- memory tools


def insert(store: str, rows: DataFrame) -> None:
    """Append memories to a stored table."""
    rows.write.mode("append").parquet(store)


def search(store: DataFrame, vector: Sequence[float], k: int = 10, least: float | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    return V.knn(store, vector, id_col, vec_col, k, threshold=least)


def delete(store: DataFrame, condition: Column) -> DataFrame:
    """What is left without the rows that meet a condition; rows where it is null stay."""
    return store.where(~F.coalesce(condition, F.lit(False)))


def reflexion_store(episodes: DataFrame, critique: DataFrame) -> DataFrame:
    """Episodes with the latest critique of each."""
    last = critique.groupBy(F.col("id").alias("of")).agg(F.max_by("critique", "ts").alias("critique"))
    return episodes.join(last, F.col("id") == F.col("of"), "left").drop("of")


def reflexion_retrieve(episodes: DataFrame, task: str, k: int = 5, only_failures: bool = False, only_successes: bool = False, least_reward: float | None = None) -> DataFrame:
    """The ``k`` episodes of a task with the greatest reward, of all or of failures or successes alone."""
    held = episodes.where(F.col("task") == task)
    if only_failures:
        held = held.where("not success")
    if only_successes:
        held = held.where("success")
    if least_reward is not None:
        held = held.where(F.col("reward") >= least_reward)
    return held.orderBy(F.desc("reward"), "id").limit(k)


def reflexion_critique_summary(episodes: DataFrame, task: str, k: int = 5) -> DataFrame:
    return reflexion_retrieve(episodes, task, k, only_failures=True)


def skill_create(skills: DataFrame, new: DataFrame) -> DataFrame:
    """Skills with new ones; a name that is there is replaced."""
    return skills.join(new.select("name"), "name", "left_anti").unionByName(new)


def skill_search(skills: DataFrame, words: Sequence[str], k: int = 10) -> DataFrame:
    """Skills whose name holds any of the words, the surest first."""
    held = [F.contains(F.lower("name"), F.lit(w.lower())) for w in words]
    hits = sum((h.cast("int") for h in held), F.lit(0))
    return skills.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("success_rate"), "name").limit(k)


def skill_consolidate(episodes: DataFrame, least_attempts: int = 3, least_reward: float = 0.7) -> DataFrame:
    """Skills from a task's episodes: ``(name, uses, success_rate, avg_reward)`` where there are enough good ones."""
    g = episodes.groupBy(F.col("task").alias("name")).agg(F.count("*").alias("uses"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("reward").alias("avg_reward"))
    return g.where((F.col("uses") >= least_attempts) & (F.col("avg_reward") >= least_reward))


def causal_add_edge(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones whose confidence is within 0 and 1."""
    return edges.unionByName(checked(new, "confidence").where("accepted").drop("accepted"))


def causal_experiment(observations: DataFrame, flag: str = "is_treatment", outcome: str = "outcome_value", *keys: str) -> DataFrame:
    return A.uplift(observations, flag, outcome, *keys)


def causal_query(edges: DataFrame, least_uplift: float = 0.0, least_confidence: float = 0.5) -> DataFrame:
    """Edges of enough uplift and confidence."""
    return edges.where((F.col("uplift") >= least_uplift) & (F.col("confidence") >= least_confidence))


def learner_discover(episodes: DataFrame, least_support: int = 3) -> DataFrame:
    """``(before, after, n, uplift)``: which task following which changes the reward."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    pairs = episodes.select(F.col("task").alias("before"), F.lead("task").over(w).alias("after"), (F.lead("reward").over(w) - F.col("reward")).alias("gain")).where("after is not null")
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n"), F.avg("gain").alias("uplift")).where(F.col("n") >= least_support)


def recall_with_certificate(chunks: DataFrame, cover: DataFrame) -> DataFrame:
    """``(query, chunks, root)``: a least set of chunks that meets all requirements and the root of its hash tree.

    ``chunks`` are ``(query, chunk, text)`` and ``cover`` is ``(query, chunk, requirement)``.
    """
    chosen = Q.hitting_set(cover).select("query", "chunk")
    held = chunks.join(chosen, ["query", "chunk"]).select("query", "chunk", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    size = held.groupBy("query").agg(F.count("*").alias("chunks"))
    return size.join(P.merkle_roots(held, "query", "chunk", "h"), "query")


# ---------------------------------------------------------------- learning and patterns


def learning_metrics(episodes: DataFrame, *keys: str) -> DataFrame:
    return episodes.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("reward").alias("reward"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("latency").alias("latency"))


def learning_predict(policies: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(session_id, task)``: the action of greatest mean for each session, ties to the least name."""
    best = policies.groupBy("session_id").agg(F.min_by("task", F.struct((-F.col("mean")).alias("low"), "task")).alias("task"))
    return sessions.select("session_id").distinct().join(best, "session_id")


def learning_explain(episodes: DataFrame, task: str, k: int = 3) -> DataFrame:
    """The episodes that speak most for an action."""
    return episodes.where((F.col("task") == task) & F.col("success")).orderBy(F.desc("reward"), "id").limit(k)


def pattern_stats(episodes: DataFrame) -> DataFrame:
    return learning_metrics(episodes, "task")


# ---------------------------------------------------------------- media tools


def search_media(media: DataFrame, vector: Sequence[float], limit: int = 10, genres: Sequence[str] | None = None, min_rating: float | None = None, condition: Column | None = None) -> DataFrame:
    """``(id, score)`` of the nearest media that pass the filters; filters come before the cut, so there are ``limit`` rows where so many pass."""
    if genres:
        media = media.where(F.arrays_overlap("genres", F.array(*[F.lit(g) for g in genres])))
    if min_rating is not None:
        media = media.where(F.col("rating") >= min_rating)
    if condition is not None:
        media = media.where(condition)
    return V.knn(media, vector, "id", "embedding", limit)


def get_recommendations(media: DataFrame, history: DataFrame, limit: int = 10) -> DataFrame:
    """``(id, score)`` nearest to the rating-weighted mean vector of a user's history ``(id, rating)``, without what is in it."""
    own = media.join(history, "id").select(F.lit(0).alias("user"), "embedding", "rating")
    row = A.mean_vector(own, "user", "embedding", F.col("rating"), V.dims_of(media)).first()
    if row is None or row["vector"] is None:
        return media.limit(0).select("id", F.lit(0.0).alias("score"))
    return V.knn(media.join(history.select("id"), "id", "left_anti"), row["vector"], "id", "embedding", limit)
