"""Incremental arrival: a directory of JSON lines as a stream.

Weights are fixed beforehand; each micro-batch is sampled like a batch would be
(the draw depends on the line's digest alone), so one pass over the files or many
give the same rows. The checkpoint takes the place of scanning for finished ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.functions.text import uniform
from grainmill.operators.mixing import Ratios, row_probability
from grainmill.sources.readers import typed
from grainmill.sources.sinks import write_shards


def json_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(value, file_path) of files as they arrive."""
    r = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def sampled(lines: DataFrame, weights: Ratios, nested: bool = True, seed: int = 0, with_text: bool = True) -> DataFrame:
    """Valid rows, each kept with the product of its values' weights."""
    rows = row_probability(typed(lines, nested, with_text), weights)
    return rows.where(uniform(F.col("line_hash"), seed) < F.col("probability")).drop("probability")


def token_windows(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Sums by event-time window and key, with late rows taken up to `late`."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream; write gets each micro-batch and its number, and must be
    idempotent for a number that comes again."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def export(stream: DataFrame, out: str, cap: int, order: str, checkpoint: str, **how) -> StreamingQuery:
    """Sampled rows as size-bounded shards: a micro-batch writes its own folder
    batch=N of shards, and writes it anew if its number comes again."""
    return run(stream, lambda df, n: write_shards(df, f"{out}/batch={n}", cap, order, **how) and None, checkpoint)
