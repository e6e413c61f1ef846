"""Token-count bins and the composite sub-class key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper edges and labels: "binary" takes low <= n < high, "decimal" low < n <= high.
LABELS = ("0-4k", "4k-8k", "8k-16k", "16k-32k", ">32k")
EDGES = {"binary": (4096, 8192, 16384, 32768), "decimal": (4000, 8000, 16000, 32000)}


def token_bin(n: Column, kind: str = "binary", zero_overflows: bool = False) -> Column:
    """The bin label of a token count. Null stays null.

    The decimal bins exclude their lower edge; a count of 0 or less then fits
    none, and by default goes to the first bin. zero_overflows=True puts it in
    the last one, as a fall-through chain of comparisons would. Binary bins put
    a negative count in the last bin."""
    edges = EDGES[kind]
    inside = (lambda e: n < e) if kind == "binary" else (lambda e: n <= e)
    low = n < 0 if kind == "binary" else (n <= 0 if zero_overflows else F.lit(False))
    c = F.when(n.isNull(), None).when(low, LABELS[-1])
    for e, label in zip(edges, LABELS):
        c = c.when(inside(e), label)
    return c.otherwise(LABELS[-1])


def bin_ordinals(spark: SparkSession) -> DataFrame:
    """(token_bin, ordinal): all labels in order, for zero-filled reports."""
    return spark.createDataFrame(list(zip(LABELS, range(len(LABELS)))), "token_bin string, ordinal int")


def subclass_key(*parts: Column) -> Column:
    """source+category+domain+language; null if any of them is."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("+"), p)
    return out
