"""The store interfaces that callers program against, over DataFrames: vectors, graphs, learning, reasoning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import api
from skein.operators import ontology as O
from skein.operators.graph import GraphStore, closure, cycles
from skein.operators.indexes import VectorIndex

__all__ = ["GraphStore", "LearningStore", "Reasoner", "VectorIndex"]


class LearningStore:
    """Experiences ``(id, session_id, ts, task, reward, success, latency)`` in a shared folder, and what is learned from them."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, experiences: DataFrame) -> LearningStore:
        experiences.write.mode("append").parquet(self.path)
        return self

    def experiences(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def train(self) -> DataFrame:
        """The policy table over all experiences."""
        return api.update_policies(self.experiences())

    def predict(self, sessions: DataFrame) -> DataFrame:
        return api.learning_predict(self.train(), sessions)

    def metrics(self, *keys: str) -> DataFrame:
        return api.learning_metrics(self.experiences(), *keys)


class Reasoner:
    """A class hierarchy ``(src, dst)`` with stated disjoint pairs ``(a, b)``."""

    def __init__(self, tree: DataFrame, disjoint: DataFrame):
        self.tree, self.disjoint = tree, disjoint

    def ancestors(self) -> DataFrame:
        """``(src, dst)`` of every class and all classes over it."""
        return closure(self.tree)

    def is_subclass(self, sub, above) -> bool:
        return sub == above or not self.ancestors().where((F.col("src") == sub) & (F.col("dst") == above)).isEmpty()

    def disjoint_pairs(self) -> DataFrame:
        return O.inherit_disjoint(self.tree, self.disjoint)

    def violations(self) -> DataFrame:
        """``(rule, node)``: classes on a cycle, and classes under both sides of a disjoint pair."""
        round_ = cycles(self.ancestors()).select(F.lit("cycle").alias("rule"), "node")
        return round_.unionByName(O.unsatisfiable(self.tree, self.disjoint).select(F.lit("disjoint").alias("rule"), "node"))
