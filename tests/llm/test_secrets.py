"""The blob ledger: versions and paths, known corpora, odd tables."""

import hashlib

from pyspark.sql import functions as F

from skein.llm import secrets
from tests.llm.test_training_data import SECRETS, brute_spans


def test_history_of_paths_is_read_once(spark, tmp_path, monkeypatch):
    ledger = f"file://{tmp_path}/ledger"
    names = "doc_id long, text string, path string, revision int, head string, blob_id string"
    history = [(i, t, f"src/{i % 3}", r, "h", "b") for r in range(4) for i, t in enumerate(SECRETS[: 3 + r])]
    found = secrets.scan(spark.createDataFrame(history, names), ledger, carry=("path", "revision")).collect()
    assert sorted((r.path, r.revision, r.blob_id) for r in found) == sorted((p, v, hashlib.sha256(t.encode()).hexdigest()) for _, t, p, v, _, _ in history)
    by = {r.blob_id: ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in ("assign", "access", "hex")) for r in found}
    assert by == {hashlib.sha256(t.encode()).hexdigest(): brute_spans(t) for t in SECRETS[:6]}
    assert secrets.read_ledger(spark, ledger).count() == 6
    # a second run over what is known reads no text but to name it
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs: 1 / 0)
    again = secrets.scan(spark.createDataFrame(history[::-1], names), ledger, carry=("path", "revision")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_few_unseen_blobs_move_no_text(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("secret: abcdef"), F.col("id").cast("string")).alias("text"))
    secrets.scan(docs, ledger).count()
    more = docs.unionByName(spark.createDataFrame([(9999, "password=hunter22")], "doc_id long, text string"))
    plans = []
    real = secrets.scan_blobs
    secrets.scan_blobs = lambda blobs: plans.append(blobs._jdf.queryExecution().executedPlan().toString()) or real(blobs)
    try:
        secrets.scan(more, ledger).count()
    finally:
        secrets.scan_blobs = real
    assert "BroadcastHashJoin" in plans[0] and "hashpartitioning" not in plans[0]
    assert secrets.read_ledger(spark, ledger).count() == 2001


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = "x " * 200_000 + "token = abcdefgh" + " y" * 1000
    rows = [(1, long), (1, long), (1, "api_key=abcdefgh"), (None, long), (None, None), (None, None), (2, "")]
    found = secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(((r.doc_id, r.spans) for r in found), key=repr) == sorted(((i, brute_spans(t or "")) for i, t in rows), key=repr)
