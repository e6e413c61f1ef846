"""End-to-end plans: mixing, cleaning, dialogue synthesis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import cleaning, conversations, mixing, model_calls
from grainmill.operators.distributions import deviation, with_bin
from grainmill.sources import readers, sinks


def mix(meta: DataFrame, ratios: mixing.Ratios, total: float, key: str, priority: Sequence[str] | None = None, seed: int = 0, top_up: str = "level", variant: str = "priority") -> tuple[DataFrame, mixing.Fit]:
    """Checks the targets, fits the cells, samples the rows. Raises on targets that can't be met."""
    own = with_bin(meta)
    check = mixing.feasibility(mixing.shares(own, list(ratios)), ratios, priority)
    if not check.ok:
        raise ValueError("; ".join(check.errors))
    f = mixing.fit(own, ratios, total, priority, variant)
    return mixing.sample(mixing.weighted(own, f, list(ratios)), total, key, seed, top_up).drop("weight"), f


def mix_files(spark: SparkSession, path: str, out: str, ratios: mixing.Ratios, total: float, cap: int, nested: bool = True, **how) -> DataFrame:
    """Directory of JSON lines to verified shards. Texts are read only for what was
    sampled; returns the deviation of each dimension's shares."""
    meta = readers.load_mix(spark, path, nested)
    sampled, _ = mix(meta, ratios, total, "line_hash", **how)
    texts = readers.verified_texts(sampled, readers.json_lines(spark, path)).where("status in ('ok', 'other_id')")
    meta_cols = F.struct("source", "category", "domain", "language", "token_count").alias("metadata")
    sinks.write_shards(texts.select("id", "text", meta_cols, "line_hash"), out, cap, "line_hash")
    return deviation(meta, sampled, tuple(ratios))


def clean_files(spark: SparkSession, path: str, out: str, **how) -> None:
    """Directory of JSON lines to cleaned documents and the log of rejects."""
    docs = readers.tolerant(spark, path, "id string, text string", exclude_suffix="_F.jsonl").withColumn("id", F.coalesce("id", F.md5("text")))
    sinks.write_cleaned(*cleaning.clean(docs, **how), out)


def synthesise(chunks: DataFrame, factory: model_calls.Factory, prompts: dict, done: DataFrame | None = None) -> DataFrame:
    """Chunks to dialogues, without those that have a result already."""
    todo = chunks if done is None else conversations.resume(chunks, done)
    return model_calls.dialogues(todo, factory, prompts).where("task = 'dialogue'")


def parquet_to_json(spark: SparkSession, path: str, out: str) -> None:
    """Every parquet file under path as JSON lines, in a folder of its relative path."""
    sinks.write_mirrored(readers.parquet(spark, path), out, root=path)
