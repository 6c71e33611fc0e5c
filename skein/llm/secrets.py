"""Secret scans over an incremental ledger of content-addressed blobs.

A text is a blob, named by the SHA-256 of its bytes; every row is one version at one
path. The ledger is a Parquet table of scanned ``(blob_id, rules_version)`` pairs with
their findings. A scan hashes each text once and stores the names, picks one row for
each blob that the ledger lacks under the present rules, appends what it finds there,
and joins the ledger back to all versions and paths. Rules are versioned by a hash of
their definitions. The rows to read are stored before texts are touched again: few of
them are broadcast, so that a run over a known corpus moves no text.

Defined results: a null text is the empty blob; every row is a path of its own,
so repeated rows each get the findings; rows alike in id and text are read by each task
that meets them, and the ledger keeps one row of them; null ids come back; an empty table
gives an empty table and leaves the ledger as it was; other columns are ignored, whatever
their names, but for those that ``carry`` names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.scratch import materialise, scratch_path

#: Kinds in the order that breaks ties, with pattern, group measured and its least length.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, False),
    ("hex", r"[0-9a-f]+", 0, 24, False),
)
#: The method's own kinds; each starts with a literal that plain prose lacks.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, False),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
)
RULES = BASE_RULES + MORE_RULES
KINDS = tuple(r[0] for r in RULES)
RULES_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
#: Literals, lower case, without one of which a rule can't match.
_NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("private key-----",), "jwt": ("eyj",), "forge": ("_",), "chat": ("xox",)}
_COMPILED = {k: re.compile(p, re.ASCII | (re.IGNORECASE if fold else 0)) for k, p, _, _, fold in RULES}
#: A run of hex digits that is long enough: the same maximal runs, without a match for each short one.
_LONG_HEX = re.compile("[0-9a-f]{24,}")


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all findings, by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    found = []
    folded = text.lower()
    for order, (kind, _, group, least, _) in enumerate(RULES):
        if kind in _NEEDS and not any(x in folded for x in _NEEDS[kind]):
            continue
        pattern = _LONG_HEX if kind == "hex" else _COMPILED[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``(blob_id, rules_version, findings)`` of ``(blob_id, text)`` rows; a blob that a batch repeats is read once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            # rows alike in id and text stand next to each other after a shuffle
            seen = set()
            b = b.take(pa.array([i for i, x in enumerate(b.column("blob_id").to_pylist()) if not (x in seen or seen.add(x))], pa.int64()))
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(x.as_py())] for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("blob_id"), pa.array([RULES_VERSION] * b.num_rows), pa.array(found, kind)], ["blob_id", "rules_version", "findings"])

    return blobs.select("blob_id", "text").mapInArrow(run, LEDGER_SCHEMA)


LEDGER_SCHEMA = "blob_id string, rules_version string, findings array<struct<start:long,end:long,kind:string>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Findings of every row of ``docs``: ``(doc_id, blob_id, findings)`` and the columns of ``carry``, such as a path and a revision.

    ``ledger`` is a folder that driver and executors share; without one a new
    ledger starts in the session's scratch folder.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry).withColumn("row_key", F.xxhash64("doc_id", "text"))
    name = F.sha2(F.col("text").cast("binary"), 256)
    paths = materialise(rows.withColumn("blob_id", name).drop("text"), "paths")
    known = read_ledger(spark, ledger).where(F.col("rules_version") == RULES_VERSION).select("blob_id")
    heads = paths.groupBy("blob_id").agg(F.min("row_key").alias("head")).join(known, "blob_id", "left_anti")
    heads = materialise(heads.select(F.col("blob_id").alias("head_blob"), "head"), "heads")
    if not heads.isEmpty():
        fresh = rows.select("row_key", "text").join(heads, F.col("row_key") == F.col("head")).where(name == F.col("head_blob")).select(F.col("head_blob").alias("blob_id"), "text")
        scan_blobs(fresh).dropDuplicates(["blob_id"]).write.mode("append").parquet(ledger)
    done = read_ledger(spark, ledger).where(F.col("rules_version") == RULES_VERSION).select(F.col("blob_id").alias("found_blob"), "findings").dropDuplicates(["found_blob"])
    done = materialise(done, "findings")  # a stored side: the join below can then split a blob that very many paths carry
    return paths.join(done, F.col("blob_id") == F.col("found_blob"), "left").select("doc_id", "blob_id", "findings", *[c for c in carry if c != id_col])


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and text form of findings, one row per document."""
    ordered = F.coalesce("findings", F.array().cast("array<struct<start:long,end:long,kind:string>>"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(ordered, lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter(ordered, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, text), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(ordered).alias("spans"), "blob_id")
