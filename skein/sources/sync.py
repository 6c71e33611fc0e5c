"""Incremental pulls behind a stored high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.scratch import materialise


class Cursor:
    """The newest ``(time, id)`` pulled so far, kept as a table in a shared folder; each pull appends one row to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def mark(self):
        """The high-water mark ``(at, id)``, or None before the first pull."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        row = self.spark.read.parquet(self.path).agg(F.max(F.struct("at", "id")).alias("m")).first()
        return row["m"]

    def pull(self, df: DataFrame, at: str, id_col: str) -> DataFrame:
        """The rows after the mark, stored; the mark moves to the newest of them once they are."""
        seen = self.mark()
        if seen is not None:
            df = df.where((F.col(at) > F.lit(seen["at"])) | ((F.col(at) == F.lit(seen["at"])) & (F.col(id_col) > F.lit(seen["id"]))))
        found = materialise(df, "pulled")
        newest = found.agg(F.max(F.struct(F.col(at).alias("at"), F.col(id_col).alias("id"))).alias("m")).where("m is not null").select("m.at", "m.id")
        newest.write.mode("append").parquet(self.path)
        return found
