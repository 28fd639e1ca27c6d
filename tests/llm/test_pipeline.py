"""The corpus pipeline, each stage against a plain version on the stage's own input."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_ops import TOKENIZER, check_packing, leaks_truth, near_truth, substring_truth

from groundwalk.llm import quality
from groundwalk.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DATA).cache()
        rows[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns

    before, after = rows["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum(labels[i] == (i in kept) for i in before if i in labels) > 0.9 * sum(i in labels for i in before)

    before, after = rows["near_dedup"]
    assert {r.doc_id for r in after} == {i for i, x in near_truth(list(before.items()), 5, 80).items() if x[2]}

    before, after = rows["substring_dedup"]
    truth = substring_truth(list(before.items()))
    assert {r.doc_id for r in after} == {i for i, (n, gone, _) in truth.items() if n > gone or n == 0}
    for r in after:
        if truth[r.doc_id][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == truth[r.doc_id][2] and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id]

    before, after = rows["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == set(before) - {d for d, _ in leaks_truth(list(before.items()), bench)}

    before, after = rows["packing"]
    check_packing(after, before, 4096)


def test_pipeline_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", None, None, None), (1, None, None, None, None), (1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).count() <= 4
        assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_names_that_clash(spark, stage):
    """Columns of the caller that are called as inner ones are kept, unchanged."""
    extra = ["score", "predicted", "kept", "packed", "text_hash", "block", "row", "h", "sheet", "c0", "component_id", "label"]
    plain = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = plain.select(*[F.concat(F.lit(f"{name} "), F.col("doc_id")).alias(name) for name in extra], "*")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    if stage == "packing":
        assert got.select("doc_id").distinct().count() == 60
        return
    rows = got.collect()
    assert got.columns == docs.columns and 0 < len(rows) <= 60
    assert all(r[name] == f"{name} {r.doc_id}" for r in rows for name in extra)
    assert {r.doc_id for r in rows} == {r.doc_id for r in dict(corpus_pipeline.STAGES)[stage](spark, plain, DATA).collect()}


def test_registered():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert TOKENIZER
