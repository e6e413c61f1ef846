"""The corpus pipeline: five stages over documents, each written and read again.

1. quality classifier: documents that it rejects go;
2. toxicity: toxic documents go;
3. near duplicates: one document of each group stays, that of least doc_id;
4. decontamination: documents that leak a benchmark item go;
5. best-fit packing: where each piece of each document goes.

All stages but the last return the columns of documents, whatever further columns
there are. Results for special cases:
* null, empty or blank text: goes in stage 1 (nothing to train on); a later stage
  that gets one keeps it, and packing gives it the length of its end mark;
* null doc_id: can't be named by the near-duplicate stage, which keeps such rows;
  all rows of a doc_id stay or go together there; other stages judge each row;
* ties: a quality score of exactly KEEP_FROM stays, a toxicity score of exactly 1
  goes, a similarity of exactly THRESHOLD makes a duplicate, of which the least
  doc_id stays;
* very long texts: judged whole by every stage;
* no labels: stage 1 lets every text pass that isn't blank, stage 2 judges by its
  word lists alone; no benchmark: stage 4 lets all pass;
* an empty table: every stage returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontaminate, near_dedup, packing, quality, toxicity
from grainmill.llm._common import by_key, keep_rows, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, "text", quality.keeper(quality.train(docs, table(spark, sf_dir, "labels"))))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stems = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, "text", lambda: toxicity.keeper(stems))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return by_key(docs, near_dedup.near_duplicates(docs).select("doc_id"), "doc_id", "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    for index in decontaminate.indexes(table(spark, sf_dir, "benchmark")):
        docs = keep_rows(docs, "text", decontaminate.keeper(index))
    return docs


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: The stages compress, align and hash: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
