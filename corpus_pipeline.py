"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs.  All but the last return the columns of ``documents``; nothing is sampled or cut.

Every stage takes any rows: null or empty texts go at the first stage, being in no language that can be told, as do
rows without a letter; very long texts are handled whole; extra columns pass through up to the last stage; an empty
table gives an empty result.  Ties between near duplicates go to the smallest doc_id, between rows of one doc_id to the
one that comes first as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from tessera.llm.common import Workspace, small, table

#: Documents whose best language explains less of them than this are rejected, as are those without a letter.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that could be told."""
    found = language_id.label(docs, language_id.learn(docs))
    pred, score, _ = found.columns[-3:]
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from texts; n_chars follows the text.  Every document stays."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays, in one row; rows without a doc_id all stay."""
    ws = Workspace(spark, "near")
    gone = ngram_join.components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = ws.put(gone, "gone")
    again = ws.put(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"), "again")
    kept = docs.join(small(gone, 16), docs["doc_id"] == F.col("_gone"), "left_anti")
    once = kept.join(small(again, 16), kept["doc_id"] == F.col("_again"), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.join(small(again, 16), kept["doc_id"] == F.col("_again"), "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.unionByName(first.select("_row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in its length bucket and token-budget batch."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", decontaminated),
    ("packing", pack),
]

#: Language inference and the edit search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
