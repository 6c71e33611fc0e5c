"""Other formats: CSV, JSON lines, Turtle; partitioned sinks."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of the Turtle subset that is read (IRIs, prefixed names, literals, punctuation).
_TURTLE = re.compile(r'@prefix\s+(?P<p>[\w-]*):\s*<(?P<iri>[^>]*)>\s*\.|(?P<tok><[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|[\w-]*:[\w.-]*\w|\ba\b|[;,.])')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema; splits are Spark's own."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, *keys: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write by partition keys. Each task writes its own file per key, so no rows move and a hot key is no single task."""
    df.write.mode(mode).partitionBy(*keys).format(fmt).save(path)


def parse_turtle(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a Turtle document with prefixes, predicate lists and object lists."""
    prefixes: dict[str, str] = {}
    subject = predicate = None
    want = "s"

    def full(t: str) -> str:
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        if t[0] == "<":
            return t[1:-1]
        if t[0] == '"':
            return t[1 : t.rindex('"')]
        p, _, name = t.partition(":")
        return prefixes.get(p, p + ":") + name

    for m in _TURTLE.finditer(re.sub(r"(?m)(^|\s)#.*$", " ", text)):
        if m["iri"] is not None:
            prefixes[m["p"]] = m["iri"]
            continue
        t = m["tok"]
        if t == ".":
            want = "s"
        elif t == ";":
            want = "p"
        elif t == ",":
            want = "o"
        elif want == "s":
            subject, want = full(t), "p"
        elif want == "p":
            predicate, want = full(t), "o"
        else:
            yield subject, predicate, full(t)


def npy_shards(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(matrix, ids)``: the bytes of two .npy files for each batch of rows, a matrix of doubles and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = []
                for x in (b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1), b.column("id").to_numpy()):
                    out = io.BytesIO()
                    np.save(out, x, allow_pickle=False)
                    held.append(out.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in held], ["matrix", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null").mapInArrow(run, "matrix binary, ids binary")


def npy_rows(shards: DataFrame) -> DataFrame:
    """``(id, vector)`` of ``(matrix, ids)`` bytes; a shard is read whole by one task, and rows of unequal number are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for matrix, ids in zip(b.column("matrix"), b.column("ids")):
                m, names = (np.load(io.BytesIO(x.as_py()), allow_pickle=False) for x in (matrix, ids))
                if len(m) != len(names):
                    raise ValueError(f"{len(m)} rows and {len(names)} ids")
                for lo in range(0, len(m), 10_000):
                    part = m[lo : lo + 10_000].astype(float)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 10_000], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["id", "vector"])

    return shards.select("matrix", "ids").mapInArrow(run, "id long, vector array<double>")


def read_npy(spark: SparkSession, matrices: str, ids: str) -> DataFrame:
    """``(id, vector)`` of .npy files and the .npy files of their ids, which go by the same names in another folder."""
    files = lambda path, name: spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias(name))
    return npy_rows(files(matrices, "matrix").join(files(ids, "ids"), "name"))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """``(s, p, o, file)`` of Turtle files; a file is parsed whole by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*t, f) for text, f in zip(b["value"], b["file"]) for t in parse_turtle(text)], columns=["s", "p", "o", "file"])

    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).mapInPandas(run, "s string, p string, o string, file string")


def to_turtle(triples: DataFrame) -> DataFrame:
    """``(s, turtle)``: one block of text per subject."""
    pair = F.format_string("<%s> \"%s\"", "p", "o")
    return triples.groupBy("s").agg(F.concat(F.format_string("<%s> ", F.col("s")), F.array_join(F.array_sort(F.collect_set(pair)), " ; "), F.lit(" .")).alias("turtle"))


def write_stream_batch(df: DataFrame, main: str, copy: str) -> None:
    """Append a batch to two stores; the copy is best effort, so its failure leaves the main store right."""
    df.persist()
    try:
        df.write.mode("append").parquet(main)
        try:
            df.write.mode("append").parquet(copy)
        except Exception as e:  # the second store may be down
            import logging

            logging.getLogger(__name__).warning("copy not written: %s", e)
    finally:
        df.unpersist()
