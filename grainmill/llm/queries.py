"""The queries of this subpackage: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import ann, chat, decontaminate, html_templates, near_dedup, packing, quality, tokens, toxicity, warc
from grainmill.llm._common import scratch_path, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))


def op2_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), keep=("page_id",))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_template_removal, op3_decontamination, op4_toxicity, op5_nearest_neighbours,
        op6_best_fit_packing, op7_quality, op8_bagminhash_near_dedup, op9_chat_formatting, op10_warc_derivatives, pipeline,
    )
}
ORACLES: dict[str, str] = {"op10_warc_derivatives": warc.sql()}
