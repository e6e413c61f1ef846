"""Writers: size-bounded JSON-line shards, mirrored outputs, exports.

Files are written by Spark's own commit protocol, so a failed or repeated task
leaves nothing behind, and mode=overwrite clears shards of an earlier save. Where a
folder for each of many names is overwritten, write_named() does the same: the protocol
moves file by file in the driver, which takes longer than all else."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from grainmill.operators.conversations import as_markdown
from grainmill.operators.packing import line_bytes, pack


def as_line(*columns: str | Column) -> Column:
    """A row as JSON text, nulls printed."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_named(rows: DataFrame, out: str, end: str = "\n") -> None:
    """Overwrites the folder out with files of given names: rows is (name, value), a name's rows
    are in one partition and stand together. Each value is written with its end as it comes, so a
    task holds no more than a batch. A file is renamed when it's whole, and the folder when all are."""
    jvm = rows.sparkSession._jvm
    last = jvm.org.apache.hadoop.fs.Path(out)
    system = last.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    last = system.makeQualified(last)
    made = jvm.org.apache.hadoop.fs.Path(last.getParent(), f"_{last.getName()}-{uuid.uuid4().hex}")
    root = re.sub("^file:/+", "file:///", made.toString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(root)
        attempt, name, sink, n = TaskContext.get().taskAttemptId(), ..., None, 0  # no name is ...

        def close() -> None:
            sink.close()
            store.move(f"{top}/{name}.{attempt}", f"{top}/{name}")

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for own, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if own != name:
                        if sink is not None:
                            close()
                        name, n = own, n + 1
                        store.create_dir(f"{top}/{name}".rpartition("/")[0])
                        sink = store.open_output_stream(f"{top}/{name}.{attempt}", buffer_size=1 << 18)
                    sink.write(((value or "") + end).encode())
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    try:
        system.mkdirs(made)
        rows.select("name", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
        system.delete(last, True)
        if not system.rename(made, last):
            raise OSError(f"{made.toString()} can't be renamed to {out}")
    except BaseException:
        system.delete(made, True)
        raise


def write_shards(rows: DataFrame, out: str, cap: int, order: str, size: Column | None = None, exact: bool = False, mode: str = "overwrite") -> DataFrame:
    """Writes rows as JSON lines in folders shard=N of at most `cap` bytes each (one
    row may exceed it) and returns (order, bytes, shard). Keys and sizes are packed;
    the rows join their shard and are written sorted within it. A row's key is its
    order, its line's digest and its number among equal lines, so each row, repeated
    or of equal order, is written once."""
    line = as_line(*rows.columns)
    own = rows.select(F.col(order).alias("__order"), line.alias("value"), (size if size is not None else line_bytes(*rows.columns)).alias("__size"))
    own = own.withColumn("__digest", F.md5("value"))
    own = own.withColumn("__copy", F.row_number().over(Window.partitionBy("__order", "__digest").orderBy("__size")))
    own = own.select(F.struct("__order", "__digest", "__copy").alias("__key"), "value", "__size")
    plan = pack(own, "__key", F.col("__size"), cap, exact=exact)
    both = own.select("__key", "value").join(plan.select("__key", "shard"), "__key")
    both = both.repartition("shard").sortWithinPartitions("shard", "__key")
    if mode == "overwrite":
        write_named(both.select(F.concat(F.lit("shard="), F.col("shard").cast("string"), F.lit("/part-00000.txt")).alias("name"), "value"), out)
    else:
        both.select("shard", "value").write.mode(mode).partitionBy("shard").text(out)
    return plan.select(F.col("__key.__order").alias(order), "bytes", "shard")


def write_limited(rows: DataFrame, out: str, max_records: int, mode: str = "overwrite") -> None:
    """JSON files of at most max_records rows; no part overwrites another."""
    rows.write.mode(mode).option("maxRecordsPerFile", max_records).option("ignoreNullFields", "false").json(out)


def relative(path: Column, root: str = "") -> Column:
    """A file's path below root, whatever the scheme; the whole path if it isn't there."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/{0,2}(?=/)", "")
    top = bare(F.lit(root.rstrip("/") + "/"))
    return F.when(F.lit(bool(root)) & F.startswith(bare(path), top), F.substring(bare(path), F.length(top) + 1, F.length(path))).otherwise(bare(path))


def write_mirrored(rows: DataFrame, out: str, file_col: str = "file_path", mode: str = "overwrite", root: str = "") -> None:
    """JSON lines in a folder for each source file, named by its path below root
    (with its suffix; Spark escapes the slashes), so files of equal name stay apart."""
    value = as_line(*[c for c in rows.columns if c != file_col])
    rows.select(relative(F.col(file_col), root).alias("src_file"), value.alias("value")).repartition("src_file").write.mode(mode).partitionBy("src_file").text(out)


def write_by_id(rows: DataFrame, out: str, id_col: str = "id", mode: str = "append") -> None:
    """A folder of JSON lines for each id."""
    rows.select(F.col(id_col).alias("item"), as_line(*rows.columns).alias("value")).write.mode(mode).partitionBy("item").text(out)


def write_cleaned(cleaned: DataFrame, rejects: DataFrame, out: str) -> None:
    """The cleaned documents and the log of rejected chunks, side by side."""
    cleaned.write.mode("overwrite").json(f"{out}/cleaned")
    rejects.write.mode("overwrite").json(f"{out}/rejects")


def write_markdown(items: DataFrame, out: str, key: str = "id", mode: str = "overwrite") -> None:
    """One markdown text a conversation, in a folder for each key. Keys that aren't
    numbers go through Spark's writer, which escapes them."""
    own = items.select(F.col(key).alias("item"), as_markdown(F.col("messages")).alias("value"))
    if mode == "overwrite" and isinstance(own.schema["item"].dataType, IntegralType):
        name = F.concat(F.lit("item="), F.coalesce(F.col("item").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/part-00000.txt"))
        write_named(own.select(name.alias("name"), "value").repartition("name").sortWithinPartitions("name"), out)
    else:
        own.write.mode(mode).partitionBy("item").option("lineSep", "\n").text(out)


def merge_parts(parts: DataFrame, out: str, mode: str = "append") -> None:
    """Adds temporary results to an output in one commit."""
    parts.write.mode(mode).json(out)
