"""Stages and operators on odd tables, with the rows each must keep; draws; scratch tables."""

import time
from pathlib import Path

import pytest

import corpus_pipeline
from skein.llm import mixing, quality_rules, simhash
from skein.plans import scratch
from tests.llm.test_training_data import DATA, docs_of

CLASH = "doc_id long, text string, lang string, source string, n_chars long, key_0 int, of_0 int, n_0 int, copy_0 int, id int, host int, block int, weight int, kept boolean"
GOOD = " ".join(f"word{i}" for i in range(80))
OTHER = " ".join(f"term{i}" for i in range(80))
LEAK = ""


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, None, s, 1, *[7] * 8, False) for i, t, s in pairs], CLASH)


def kept(spark, stage, df):
    out = dict(corpus_pipeline.STAGES)[stage](spark, df, DATA)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_quality_judges_rows_without_or_with_shared_ids(spark):
    df = rows(spark, (None, GOOD, "a"), (None, "short", None), (1, GOOD, ""), (1, "short", "a"), (2, None, "a"), (3, GOOD, None), (3, GOOD, None))
    assert kept(spark, "quality rules", df) == [(1, GOOD), (3, GOOD), (3, GOOD), (None, GOOD)]


def test_first_of_near_duplicates_is_the_same_on_each_run(spark):
    df = rows(spark, (5, GOOD, "a"), (3, GOOD, "b"), (3, GOOD, "c"), (3, OTHER, "a"), (7, OTHER, "a"), (7, OTHER, "a"), (None, GOOD, "a"), (9, "x y z alone", "a"), (9, "x y z alone", "a"), (None, "without any id", "a"))
    found = kept(spark, "near duplicates", df)
    assert found == [(3, OTHER), (3, GOOD), (9, "x y z alone")] and found == kept(spark, "near duplicates", df.repartition(3, "source"))
    one = [r.source for r in simhash.keep_first(df).where(f"text = '{GOOD}'").collect()]
    assert one == [r.source for r in simhash.keep_first(df.orderBy("source", ascending=False)).where(f"text = '{GOOD}'").collect()]


def test_benchmark_stage_on_odd_rows(spark):
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    df = rows(spark, (1, f"before {leak} after", "a"), (1, GOOD, "a"), (None, leak, "a"), (None, GOOD, None), (2, None, "a"), (3, "", "a"), (3, "", "a"))
    assert kept(spark, "benchmark", df) == sorted([(1, GOOD), (None, GOOD), (2, None), (3, ""), (3, "")], key=repr)


def test_mixture_keeps_documents_without_words(spark):
    df = rows(spark, (1, GOOD, "a"), (2, GOOD + " " + GOOD, "b"), (3, None, "empty"), (4, " ", "empty"), (5, "", None), (None, GOOD, "a"))
    found = kept(spark, "mixture", df)
    assert {i for i, _ in found} == {1, 2, 3, 4, 5, None}
    assert all(n <= 2 for n in [found.count(x) for x in found])
    assert corpus_pipeline.mixture(spark, df.limit(0), DATA).collect() == []


def test_draws_are_permutations_of_blocks(spark):
    docs = docs_of(spark, ["w " * (5 + i % 7) for i in range(300)], ["big" if i < 250 else "small" for i in range(300)])
    mixed = mixing.mix(docs, max_repeat=3.0, target_entropy=None, cover=True)
    block = {r.doc_id: r.block for r in mixed.collect()}
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    drawn = sorted(((r.source, r["pass"], r.block_place, r.place, r.doc_id) for r in mixing.draws(mixed).collect()))
    orders = {}
    for source, n, _, _, doc in drawn:
        orders.setdefault((source, n), []).append(doc)
    assert {d: sum(o.count(d) for o in orders.values()) for d in copies} == copies
    for order in orders.values():
        assert len(set(order)) == len(order)
        turns = [b for i, b in enumerate(block[d] for d in order) if not i or b != block[order[i - 1]]]
        assert len(turns) == len(set(turns))  # a block's documents stand together
    one, two = orders["small", 1], orders["small", 2]
    assert sorted(one) == sorted(two) and one != two and list(dict.fromkeys(block[d] for d in one)) != list(dict.fromkeys(block[d] for d in two))


def test_host_verdicts_change_rows_both_ways(spark):
    """The same document goes in a bad host and stays in a good one."""
    junk = " ".join(f"word{i}#" for i in range(80))
    pairs = [(i, junk if i % 10 else GOOD, "bad") for i in range(60)] + [(100 + i, GOOD, "good") for i in range(59)] + [(200, junk, "good")]
    found = {r.doc_id: (r.base_failed, r.n_failed, r.kept) for r in quality_rules.judge(rows(spark, *pairs)).collect()}
    assert found[1] == (False, 1, False) and found[200] == (False, 1, True) and found[0] == (False, 0, True)


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_on_an_empty_table(spark, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, rows(spark).limit(0) if stage else spark.createDataFrame([], CLASH), DATA).collect() == []


def test_released_scratch_is_gone(spark):
    made = len(scratch._made)
    df = scratch.materialise(spark.range(5), "released")
    assert df.count() == 5 and len(scratch._made) == made + 1
    keep, scratch._made[:] = scratch._made[:made], scratch._made[made:]
    assert scratch.release(spark) == 1 and scratch._made == []
    scratch._made[:] = keep
    with pytest.raises(Exception):
        df.count()


def test_quality_sends_each_text_to_python_once(spark):
    df = rows(spark, (1, GOOD, "a"), (2, "short", None)).withColumnRenamed("text", "Text")
    found = quality_rules.keep_good(df, text_col="text")
    assert [(r.doc_id, r.Text) for r in found.collect()] == [(1, GOOD)] and found.columns == df.columns
    plan = found._jdf.queryExecution().analyzed().toString()
    sent = [line for line in plan.splitlines() if "struct(doc_id" in line]
    assert len(sent) == 1 and "AS text" not in sent[0]


def test_stored_tables_leave_no_shuffle_files(spark):
    def ids():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    before, was = ids(), spark.conf.get(scratch._CLEANUP, None)
    df = scratch.materialise(spark.range(1000).repartition(3, "id"), "shuffled")
    assert spark.conf.get(scratch._CLEANUP, None) == was
    for _ in range(100):  # they go in the background
        if not ids() - before:
            break
        time.sleep(0.1)
    assert ids() <= before and df.count() == 1000
