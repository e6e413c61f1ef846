"""SimHash near-duplicates: 64-bit hashes of word 6-grams, six blocks, four bits.

Two hashes within 4 of 64 bits agree in at least two of six blocks, so each hash
is keyed by its 15 pairs of blocks; texts that share a key are compared by
bit_count of the difference. Equal hashes collapse to one before that, so groups
of copies cost nothing; a component's least id stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.text import let
from grainmill.operators.components import components, ensure_checkpoint_dir

BLOCKS = (11, 11, 11, 11, 10, 10)


def shingles(text: Column, window: int = 6) -> Column:
    """Hashes of runs of `window` words, lower case, without punctuation; a text
    of fewer words is one run."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"\p{P}", "")), r"\s+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        """A word is hashed once, a run by its words' hashes."""
        many = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(F.size(h) >= window, many).when(F.size(h) > 0, F.array(F.xxhash64(h)))

    return let(words, lambda own: let(F.transform(own, lambda w: F.xxhash64(w)), runs))


def _sum_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for h in batch.column(1):
            v, n = h.values.to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
            for i in range(0, len(v), 65536):
                n += np.unpackbits(v[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * n > len(v), bitorder="little").view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "h"])


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 6) -> DataFrame:
    """(id, h): the 64-bit SimHash, whose bit b is set where most shingles have it.
    Texts without words and null ids are left out. Words are hashed by built-in
    expressions; bits are added up in Arrow batches, as array work."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), shingles(F.col(text_col), window).alias("s")).where("size(s) > 0")
    return own.mapInArrow(_sum_bits, f"id {kind}, h bigint")


def _keys(h: Column) -> Column:
    at, parts = 0, []
    for n in BLOCKS:
        parts.append(F.call_function("shiftrightunsigned", h, F.lit(at)).bitwiseAND(F.lit((1 << n) - 1)))
        at += n
    return F.array(*[F.xxhash64(F.lit(k), parts[i], parts[j]) for k, (i, j) in enumerate(combinations(range(6), 2))])


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 6, most: int = 4) -> DataFrame:
    """(a, b) with a < b: ids whose hashes differ in at most `most` bits; of ids with
    equal hashes only the pairs with the least of them."""
    ensure_checkpoint_dir(docs.sparkSession)
    own = hashes(docs, id_col, text_col, window).checkpoint()  # three branches read it: texts are hashed once
    least = own.withColumn("rep", F.min("id").over(Window.partitionBy("h")))
    same = least.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    keyed = least.where("id = rep").select("id", "h", F.explode(_keys(F.col("h"))).alias("key"))
    x, y = keyed.toDF("a", "ha", "key"), keyed.toDF("b", "hb", "key")
    near = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= most)).select("a", "b").distinct()
    return near.union(same)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that an id of their component precedes; null ids stay."""
    gone = components(pairs(docs, id_col, text_col, **how)).select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
