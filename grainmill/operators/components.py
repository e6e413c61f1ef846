"""Connected components of a table of edges (a, b), and the session's scratch folder.

Passes grow with the logarithm of the longest chain. Edges are checkpointed every
pass, in the session's checkpoint folder, so a lost executor doesn't replay all of
them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where it is unset, a local session has a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="grainmill-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder within the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node but the least of its component.

    Edges point from a node to a lesser one. A pass links each node's greater
    neighbours to its least one (large star), then its lesser ones (small star), which
    leaves the components as they are and makes stars of them; see Kiveris and others,
    "Connected components in MapReduce and beyond", 2014."""
    ensure_checkpoint_dir(edges.sparkSession)
    by = Window.partitionBy("a")
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    was = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != was:
        was = state
        both = now.union(now.select("b", "a"))
        large = both.select("a", "b", F.least(F.min("b").over(by), "a").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.distinct().select("a", "b", F.min("b").over(by).alias("m"))
        links = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = links.select("e.*").where("a != b").distinct().checkpoint()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
