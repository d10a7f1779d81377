"""Corpus pipeline: language identification, line dedup, n-gram Jaccard join, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again for the next one. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addresskit.llm import common, decontaminate, language_id, line_dedup, mixing, ngram_join

LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of LEAST_SCORE or more; ``und`` goes."""
    learn = docs.where(~language_id.held_out(docs)).select("doc_id", "text", "lang")
    into = common.free_name("language", docs.columns)
    told = language_id.identify(docs, learn, into=into)
    return told.where((F.col(into)["pred"] != language_id.UND) & (F.col(into)["score"] >= LEAST_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of each group of equal or near lines; a document without a line of its own goes."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("_line_counts.removed") > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(docs, items)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row per copy (``copy`` from 1)."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mix_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
