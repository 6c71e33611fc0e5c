"""Hash trees over ordered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.ordered import running
from skein.plans.scratch import materialise


def merkle_roots(chunks: DataFrame, key: str, pos: str, hash_col: str) -> DataFrame:
    """``(key, root)``: pairs hashed level by level, an odd last node carried up as it is.

    Rounds are the log of the longest group; each is one grouped aggregation of pairs.
    """
    level = running(chunks.select(key, pos, F.col(hash_col).alias("h")), [key], [F.col(pos)], "n").select(key, (F.col("n") - 1).alias("i"), "h")
    most = chunks.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        pair = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(key, F.expr("i div 2").alias("j")).agg(F.when(F.count("*") == 2, F.sha2(pair.cast("binary"), 256)).otherwise(F.any_value("h")).alias("h")).select(key, F.col("j").alias("i"), "h")
        most = (most + 1) // 2
    return level.select(key, F.col("h").alias("root"))


def merkle_proofs(chunks: DataFrame, key: str, pos: str, hash_col: str) -> DataFrame:
    """``(key, pos, level, left, sibling)``: what each chunk needs to reach the root; ``left`` tells the sibling's side.

    Levels where a node has no sibling give no row. Each round is one grouped aggregation of pairs and one join of chunks to it.
    """
    level = running(chunks.select(key, F.col(pos).alias("pos"), F.col(hash_col).alias("h")), [key], [F.col("pos")], "n").select(key, "pos", (F.col("n") - 1).alias("i"), "h")
    most = level.agg(F.max("i")).first()[0] or 0
    place, nodes, out, n = level.select(key, "pos", "i"), level.select(key, "i", "h"), None, 0
    while most > 0:
        beside = nodes.select(key, F.col("i").bitwiseXOR(F.lit(1)).alias("i"), F.col("h").alias("sibling"))
        step = place.join(beside, [key, "i"]).select(key, "pos", F.lit(n).alias("level"), (F.col("i") % 2 == 1).alias("left"), "sibling")
        out = step if out is None else out.unionByName(step)
        pair = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
        nodes = nodes.groupBy(key, F.expr("i div 2").alias("j")).agg(F.when(F.count("*") == 2, F.sha2(pair.cast("binary"), 256)).otherwise(F.any_value("h")).alias("h")).select(key, F.col("j").alias("i"), "h")
        nodes = materialise(nodes, "merkle")
        place, most, n = place.select(key, "pos", F.expr("i div 2").alias("i")), most // 2, n + 1
    return out if out is not None else level.select(key, "pos", F.lit(0).alias("level"), F.lit(False).alias("left"), F.col("h").alias("sibling")).where("false")
