"""A training corpus from raw documents: five stages, each a written table that the next one reads.

quality rules -> near duplicates -> repeated passages -> benchmark passages -> mix.

Rows are told apart by a key of their own, not by doc_id: a row without doc_id, or one that shares its doc_id with another
text, stays unless a stage has a reason of its own against it. Of rows alike one stays (near duplicates). What each stage does with odd rows:
null and empty texts fail the quality rules; a row that loses all of its text as repeated passages stays with an empty text;
a null source is a source of its own in the mix. An empty table gives an empty result; further columns are carried along up
to the mix, which returns doc_id, source, block, slot, text and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import keyed, scratch_dir, tidy, written
from cairn.llm.decontamination import benchmark_hits
from cairn.llm.mixing import mixing
from cairn.llm.near_duplicates import near_duplicates
from cairn.llm.quality_rules import good_documents
from cairn.llm.queries import MIX
from cairn.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps."""
    return good_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest doc_id (rows without one come last)."""
    with tidy(spark):  # the stage's own tables go, its result stays
        rows, key = keyed(docs)
        first = near_duplicates(rows, row=key).where("first").select(F.col("row").alias(key))
        return written(rows.join(first, key, "left_semi").select(docs.columns), "stage", keep=True)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also start earlier; n_chars follows."""
    with tidy(spark):
        rows, key = keyed(docs)
        cut = suffix_dedup(rows, with_text=True, row=key).select(F.col("row").alias(key), F.col("kept_text").alias("text"))
        new = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
        return written(rows.drop("text", "n_chars").join(cut, key).withColumns(new).select(docs.columns), "stage", keep=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    with tidy(spark):
        rows, key = keyed(docs)
        hits = benchmark_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=key)
        return written(rows.join(hits.where(F.size("hits") > 0).select(F.col("row").alias(key)), key, "left_anti").select(docs.columns), "stage", keep=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its block and slot in the mix of sources."""
    return mixing(docs, MIX, with_columns=True).select("doc_id", "source", "block", "slot", "all.text", "all.lang")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate),
    ("repeated passages", passages),
    ("benchmark passages", benchmark),
    ("mix", mix),
]

#: Signatures and suffix indexes are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}-stage{k}")
        docs = spark.read.parquet(f"{root}-stage{k}")
    return docs
