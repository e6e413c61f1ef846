"""Distributions of a corpus by its dimensions.

Shares are computed in one aggregation and a window over the (few) groups, so a
corpus is read once, with partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.bins import bin_ordinals, subclass_key, token_bin

DIMENSIONS = ("source", "category", "domain", "language", "token_bin")


def with_bin(meta: DataFrame, kind: str = "binary") -> DataFrame:
    return meta if "token_bin" in meta.columns else meta.withColumn("token_bin", token_bin(F.col("token_count"), kind))


def distribution(meta: DataFrame, dim: str, weight: str = "token_count") -> DataFrame:
    """(dim, share), descending: each value's part of the total weight. Null
    values are left out; a total of 0 gives no rows."""
    sums = meta.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    return sums.select(dim, F.col("w").cast("double").alias("w"), total.cast("double").alias("t")).where("t != 0").select(dim, (F.col("w") / F.col("t")).alias("share")).orderBy(F.desc("share"), dim)


def row_distribution(meta: DataFrame, dim: str) -> DataFrame:
    """(dim, n, share): counts of rows instead of tokens."""
    counts = meta.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distributions(meta: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dim, value, tokens, n, share) of several dimensions in one pass. Rows are
    added up to cells (combinations of values) first, with partial sums before the
    shuffle; only cells are expanded by GROUPING SETS."""
    own = with_bin(meta).groupBy(*dims).agg(F.sum("token_count").alias("tokens"), F.count("*").alias("n"))
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d)) for d in dims])
    rows = own.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(which.alias("dim"), value.alias("value"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    by = Window.partitionBy("dim")
    return rows.where("value is not null").select("dim", "value", "tokens", "n", (F.col("tokens") / F.sum("tokens").over(by)).alias("share"))


def ordered_bins(meta: DataFrame) -> DataFrame:
    """(token_bin, ordinal, share): all five bins in order, 0 where none is."""
    own = distribution(with_bin(meta), "token_bin")
    return F.broadcast(bin_ordinals(meta.sparkSession)).join(own, "token_bin", "left").select("token_bin", "ordinal", F.coalesce("share", F.lit(0.0)).alias("share")).orderBy("ordinal")


def top_subclasses(meta: DataFrame, k: int) -> DataFrame:
    """The k sub-classes of most tokens."""
    key = subclass_key(*[F.col(c) for c in ("source", "category", "domain", "language")])
    return distribution(meta.withColumn("subclass", key), "subclass").limit(k)


def summary(meta: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(n, tokens, mean_tokens[, ratio]): ratio is this corpus's part of the tokens of `of`."""
    own = meta.agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("mean_tokens"))
    if of is None:
        return own
    return own.crossJoin(of.agg(F.sum("token_count").alias("all_tokens"))).withColumn("ratio", F.col("tokens") / F.col("all_tokens")).drop("all_tokens")


def unique_ids(meta: DataFrame, id_col: str) -> DataFrame:
    """(unique_ids, share): distinct ids, null left out, and their part of all rows."""
    return meta.agg(F.countDistinct(id_col).alias("unique_ids"), (F.countDistinct(id_col) / F.count("*")).alias("share"))


def distinct_values(meta: DataFrame, dim: str) -> DataFrame:
    return meta.select(dim).where(F.col(dim).isNotNull()).distinct().orderBy(dim)


def shard_estimate(meta: DataFrame, cap: int, text_col: str = "text") -> DataFrame:
    """(total_bytes, shards): UTF-8 bytes with a line's end each, over the cap, rounded up."""
    total = F.sum(F.octet_length(text_col) + 1)
    return meta.agg(total.alias("total_bytes"), F.ceil(total / F.lit(cap)).cast("bigint").alias("shards"))


def per_file(meta: DataFrame, file_col: str = "file_path") -> DataFrame:
    """(file, n, tokens) for progress reports."""
    return meta.groupBy(file_col).agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def outcomes(results: DataFrame, ok: Column, error: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(done, failed) counts, and the first five errors by key."""
    return results.agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed")), results.where(~ok).orderBy(key).select(key, error).limit(5)


def fingerprint(meta: DataFrame) -> DataFrame:
    """One number for a table's contents, whatever its order."""
    return meta.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*meta.columns).cast("decimal(38,0)")).alias("fingerprint"))


def deviation(original: DataFrame, sampled: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dim, max_deviation): the greatest difference of share over the values of
    the original; a value that the sample lacks counts as 0 there, one that
    only the sample has doesn't count."""
    a, b = distributions(original, dims), distributions(sampled, dims)
    both = a.join(b.select("dim", "value", F.col("share").alias("other")), ["dim", "value"], "left")
    return both.groupBy("dim").agg(F.max(F.abs(F.col("share") - F.coalesce("other", F.lit(0.0)))).alias("max_deviation"))
