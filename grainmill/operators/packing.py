"""Size-bounded shards: a running sum of bytes that starts anew when the next row
would exceed the cap. A row over the cap has a shard of its own.

Each reset depends on the one before, so a stretch of rows is packed in order by
one task. pack() does so within range partitions of the order, and numbers the
shards through by a prefix sum over partitions; each partition ends a shard.
exact=True puts all rows in one partition (ids and sizes only) and gives what a
single loop over all rows would."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.components import ensure_checkpoint_dir


def line_bytes(*columns: str) -> Column:
    """UTF-8 bytes of the row as a JSON line with its end."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) + 1


def text_bytes(text: str = "text") -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))) + 1


def greedy(sizes: list[int], cap: int) -> list[int]:
    """Shard numbers from 0."""
    out, shard, held = [], 0, 0
    for n in sizes:
        if held and held + n > cap:
            shard, held = shard + 1, 0
        out.append(shard)
        held += n
    return out


def _packer(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = 0
        for b in batches:
            own = []
            for n in b.column(1).to_pylist():
                if held and held + n > cap:
                    shard, held = shard + 1, 0
                own.append(shard)
                held += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.int64())], names=["__order", "__bytes", "__part", "__shard"])

    return run


def pack(rows: DataFrame, order: str, size: Column, cap: int, partitions: int | None = None, exact: bool = False) -> DataFrame:
    """(order, bytes, shard): shards from 1 in the order's sequence."""
    kind = rows.schema[order].dataType.simpleString()
    own = rows.select(F.col(order).alias("__order"), size.cast("bigint").alias("__bytes"))
    spread = own.repartition(1) if exact else own.repartitionByRange(partitions or rows.sparkSession.sparkContext.defaultParallelism, "__order")
    sorted_ = spread.sortWithinPartitions("__order").withColumn("__part", F.spark_partition_id())
    made = sorted_.mapInArrow(_packer(cap), f"__order {kind}, __bytes bigint, __part int, __shard bigint")
    if exact:
        return made.select(F.col("__order").alias(order), F.col("__bytes").alias("bytes"), (F.col("__shard") + 1).alias("shard"))
    # range bounds are sampled, so the numbers of one run are kept (ids and sizes
    # only, in the checkpoint folder) before they are added up
    ensure_checkpoint_dir(rows.sparkSession)
    made = made.checkpoint()
    parts = made.groupBy("__part").agg((F.max("__shard") + 1).alias("n"))
    base = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("base"))
    return made.join(base, "__part").select(F.col("__order").alias(order), F.col("__bytes").alias("bytes"), (F.col("base") + F.col("__shard") + 1).alias("shard"))
