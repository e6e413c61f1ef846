"""What the operators of this subpackage share: the scratch folder and narrow inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_heap() -> None:
    """Makes glibc keep freed memory up to 64 MB in this Python worker: array code
    else pays a page fault for every 4 KB of every temporary. Elsewhere, no effect."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder of the session, from spark.checkpoint.dir, else the context's
    checkpoint folder; where both are unset, a local session (a test) has a
    temporary folder of this machine, and a cluster has an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="grainmill-"))
        root = _own_root[0]
    return f"{root.rstrip('/')}/grainmill"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_temporary: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the scratch folder, if it is still there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within are deleted at the end, but for those with keep=True."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            remove(spark, path)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends in
    files that outlive any executor, and nothing upstream runs twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if _temporary and not keep:
        _temporary[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A semi- or anti-join side is broadcast up to this many 8-byte keys (about
#: 32 MB as a hash relation); beyond it both sides are shuffled on the key.
BROADCAST_KEYS = 1_000_000


def by_key(df: DataFrame, keys: DataFrame, name: str, how: str) -> DataFrame:
    """df left_semi or left_anti keys (one BIGINT column, already written), on
    df's column `name`. Counts keys first and broadcasts only a small side."""
    own = keys.toDF("__grainmill_key")
    if own.count() <= BROADCAST_KEYS:
        own = F.broadcast(own)
    return df.join(own, F.col(f"`{name}`") == F.col("__grainmill_key"), how)


def broadcast_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of df whose doc_id is in ids, a list that a parameter bounds."""
    own = df.sparkSession.createDataFrame([(i,) for i in ids], "__grainmill_key bigint")
    return df.join(F.broadcast(own), F.col("doc_id") == F.col("__grainmill_key"), "left_semi")


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, for which the function that make() gives says
    true of the column's value; make() runs once a task, on its executor. Only
    that column goes to Python and only booleans come back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep = make()
        for x in batches:
            yield pa.array(keep(x.to_pylist()), pa.bool_())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.where(F.arrow_udf(run, "boolean")(F.col(f"`{column}`")))
