"""Lineage cuts: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Whether Spark deletes an action's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local-mode session (one machine, as in tests) may leave it unset; a
    folder is then made and recorded in the session. A cluster without the
    setting is an error, since executors would not see a machine-local folder.
    """
    base = spark.conf.get(_KEY, None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{scratch_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this driver has put into the shared folder, for a caller that is done with its results; how many paths went."""
    gone = 0
    while _made:
        gone += _delete(spark, _made.pop())
    return gone


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    n = 0
    while f"{stem}_{n}" in taken:
        n += 1
    return f"{stem}_{n}"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Actions begun inside delete their shuffle files at their end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Later plans read the stored rows: nothing above is computed again, and a
    lost executor loses no intermediate rows. The write's shuffle files go as it
    ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, parts: int, key: str, tag: str) -> DataFrame:
    """``materialise`` by hash of ``key`` in ``parts`` buckets, so that joins on it move only their other side."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    name = "skein_" + uuid.uuid4().hex
    with _shuffles_go(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the plan keeps files and buckets, the catalog needs no entry
    spark.sql(f"drop table {name}")  # an external table's files stay
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` gave, once nothing reads it any more; other tables stay."""
    path = getattr(df, "_scratch", None)
    if path in _made:
        _made.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
