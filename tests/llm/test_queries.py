"""Registered queries against their SQL, and the pipeline's stages against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm.queries import ORACLE_SQL, QUERIES
from verify import compare

from .test_operators import brute_classes, brute_dedup, brute_hits, text_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    said = compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf)
    assert ": ok" in said, said


def test_all_operators_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]


def test_pipeline_stages(spark, sf):
    from cairn.llm.common import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: written(stages[name](spark, d, sf), "stage")
    kept = step("quality rules", docs)
    verdicts = QUERIES["op1_quality_rules"](spark, sf).where("kept").select("doc_id")
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in verdicts.collect()}
    apart = step("near duplicates", kept)
    classes = brute_classes(text_of(kept))
    assert sorted(text_of(apart)) == sorted(set(classes.values()))
    cut = step("repeated passages", apart)
    before, after, want = text_of(apart), text_of(cut), brute_dedup(text_of(apart))
    assert before.keys() == after.keys()
    for i, t in after.items():
        assert want[i][0] - want[i][1] - 6 * want[i][2] <= len(t.encode()) <= want[i][0] - want[i][1]
    clean = step("benchmark passages", cut)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits(after, items)
    assert sorted(text_of(clean)) == sorted(i for i in after if not hits[i][4])
    mixed = step("mix", clean)
    assert mixed.select("doc_id").exceptAll(clean.select("doc_id")).count() == 0 and mixed.count() == clean.count()
    assert corpus_pipeline.run(spark, sf).select("doc_id").exceptAll(mixed.select("doc_id")).count() == 0
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0


def test_pipeline_odd_rows(spark, sf):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, True), (2, "", "en", "s", 0, True), (None, "x " * 300, "en", "s", 5, None), (3, " ".join(f"word{i}" for i in range(300)), "en", None, None, False)],
        "doc_id long, text string, lang string, source string, n_chars long, kept boolean",
    )
    texts_ = [" ".join(f"{w}{i}" for i in range(300)) for w in ("one", "two", "six", "ten")]
    same_id = spark.createDataFrame([(7, t, "en", "s", 9, True) for t in texts_[:3]] + [(None, texts_[3], "en", "s", 9, True)] * 2, docs.schema)
    kept = corpus_pipeline.near_duplicate(spark, same_id, sf)
    assert sorted(r.text for r in kept.collect()) == sorted(texts_), "different texts stay whatever their ids, of rows alike one"
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert sorted(r.text for r in stage(spark, kept, sf).collect()) == sorted(texts_)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf)
            assert name == "mix" or out.columns == d.columns
            assert out.count() <= d.count()
