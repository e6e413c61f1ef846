"""Readers: JSON lines with validation, metadata index, parquet, markdown, configuration."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("source", "category", "domain", "language", "token_count")


def json_lines(spark: SparkSession, path: str, exclude_suffix: str | None = None) -> DataFrame:
    """(value, file_path): the lines of every file under path whose name ends in
    .jsonl in any case, but for names that end in exclude_suffix (a tool's own output)."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(path)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("__name"))
    if exclude_suffix:
        rows = rows.where(~F.endswith("__name", F.lit(exclude_suffix)))
    return rows.drop("__name")


def tolerant(spark: SparkSession, path: str, schema: str, **how) -> DataFrame:
    """Objects of well-formed lines; others and blank lines are skipped."""
    lines = json_lines(spark, path, **how).where("trim(value) != ''")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o"), F.try_parse_json("value").alias("v")).where("v is not null").select("o.*")


def token_number(x: Column) -> Column:
    """A token count from a number or numeric text, cut towards 0; null where it is none, NaN or infinite."""
    return x.try_cast("double").try_cast("bigint")


def _object(value: Column) -> Column:
    """map<string, string> of a JSON object's fields; a JSON null is a null in the map."""
    return F.from_json(value, "map<string,string>")


def typed(lines: DataFrame, nested: bool = False, with_text: bool = True, null_as: str | None = None) -> DataFrame:
    """Valid rows of (value, file_path): all fields present and the count a number.

    Flat rows have them at the top, nested ones under metadata (which must be an
    object). A field that is present with null: the row goes, or null_as stands in
    for it ("None" for parity with loaders that print the value). line_hash is the
    md5 of the line with its end; `text` isn't read unless with_text."""
    top = lines.where(F.try_parse_json("value").isNotNull()).withColumn("__top", _object(F.col("value"))).where("__top is not null and map_contains_key(__top, 'text')")
    own = _object(F.element_at("__top", "metadata")) if nested else F.col("__top")
    rows = top.withColumn("__own", own).where(" and ".join(["__own is not null", *(f"map_contains_key(__own, '{f}')" for f in FIELDS)]))
    get = lambda f: F.coalesce(F.element_at("__own", f), F.lit(null_as)) if null_as else F.element_at("__own", f)
    ident = F.try_element_at(F.col("__top"), F.lit("id"))
    cols = [ident.alias("id"), *[get(f).alias(f) for f in FIELDS[:-1]], token_number(F.element_at("__own", "token_count")).alias("token_count")]
    cols += [F.element_at("__top", "text").alias("text")] if with_text else []
    out = rows.select(*cols, "file_path", F.md5(F.concat("value", F.lit("\n"))).alias("line_hash"))
    return out.where(" and ".join(f"{f} is not null" for f in FIELDS))


def load_mix(spark: SparkSession, path: str, nested: bool = True, with_text: bool = False) -> DataFrame:
    """The metadata index of a corpus directory; Catalyst never materialises text without with_text."""
    return typed(json_lines(spark, path), nested, with_text)


def verified_texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """wanted (id, file_path, line_hash, ...) with `text` and `status` from its line:
    ok, missing (no such line), invalid (no JSON), other_id (its id differs). Equal
    lines of a file are one line."""
    src = lines.select("file_path", F.md5(F.concat("value", F.lit("\n"))).alias("line_hash"), "value").dropDuplicates(["file_path", "line_hash"])
    both = wanted.join(src, ["file_path", "line_hash"], "left")
    parsed = F.try_parse_json("value").isNotNull()
    o = _object(F.when(parsed, F.col("value")))
    status = F.when(F.col("value").isNull(), "missing").when(~parsed, "invalid").when(~F.try_element_at(o, F.lit("id")).eqNullSafe(F.col("id").cast("string")), "other_id").otherwise("ok")
    return both.withColumn("status", status).withColumn("text", F.try_element_at(o, F.lit("text"))).drop("value")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Every parquet file under path, in any case of its suffix, with its file_path."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(text, file_path): whole .md files of a folder, not of its sub-folders."""
    df = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return df.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path"))


def dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A saved dataset: the union of its shards."""
    return spark.read.option("pathGlobFilter", "*.json*").json(folder)


def training_mix(sources: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """The first rows of each source, up to its limit, as one table."""
    out = None
    for df, n in sources:
        out = df.limit(n) if out is None else out.unionByName(df.limit(n), allowMissingColumns=True)
    return out


def preview(lines: DataFrame, n: int = 3, width: int = 100) -> DataFrame:
    return lines.limit(n).select(F.substring("value", 1, width).alias("value"))


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]] | None:
    """(path, path below `path`) of all files of a folder, or of a file, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(p):
        return None
    top, out, found = system.getFileStatus(p).getPath().toString().rstrip("/"), [], system.listFiles(p, True)
    while found.hasNext():
        name = found.next().getPath().toString()
        out.append((name, name[len(top) + 1 :]))
    return sorted(out)


def diagnose(spark: SparkSession, path: str, suffix: str = "") -> dict:
    """Whether a path exists, is a folder, and how many names under it end in suffix."""
    found = _files(spark, path)
    own = [r for _, r in found or () if r]
    return {"exists": found is not None, "is_dir": found is not None and (bool(own) or not found), "files": sum(r.endswith(suffix) for r in own)}


def tree(spark: SparkSession, path: str, ignore_dirs: Sequence[str] = (), ignore_files: Sequence[str] = ()) -> tuple[list[str], list[str]] | tuple[None, None]:
    """(paths, names) of a file, or of a folder's files but for those to ignore."""
    found = _files(spark, path)
    if found is None:
        return None, None
    name = lambda p: p.rpartition("/")[2]
    own = [p for p, r in found if not r or (name(p) not in ignore_files and not set(r.split("/")[:-1]) & set(ignore_dirs))]
    return own, [name(p) for p in own]


def models(spec: str) -> list[dict]:
    """Model endpoints: "path,name,key;..." or JSON/YAML text of a list, or of an object with `models`."""
    if spec.lstrip()[:1] in "[{-" or "\n" in spec.strip():
        try:
            got = json.loads(spec)
        except ValueError:
            import yaml

            got = yaml.safe_load(spec)
        return list(got["models"] if isinstance(got, dict) else got)
    out = []
    for part in filter(None, (x.strip() for x in spec.split(";"))):
        if len(own := [x.strip() for x in part.split(",")]) != 3:
            raise ValueError(f"a model needs path,name,key: {len(own)} parts")
        out.append(dict(zip(("api_path", "model_name", "api_key"), own)))
    return out


def invalid_model(m: dict) -> str | None:
    """What is wrong with an endpoint's configuration, if anything."""
    missing = [k for k in ("api_path", "model_name", "api_key") if not m.get(k)]
    if missing:
        return "missing: " + ", ".join(missing)
    if not isinstance(m.get("concurrency", 1), int) or m.get("concurrency", 1) <= 0:
        return "concurrency must be a positive integer"
    return None if m.get("model_type", "instruct") in ("thinking", "instruct", "mix") else "unknown model_type"


def prompt(prompts: dict, category: str, key: str, default: str = "") -> str:
    return prompts.get(category, {}).get(key, default)


def choose_model(configs: Sequence[dict], kind: str, pick: int = 0) -> dict:
    """The pick-th endpoint (around the end) of the kind; else of "thinking", else of any."""
    for own in ([c for c in configs if c.get("model_type") == kind], [c for c in configs if c.get("model_type") == "thinking"], list(configs)):
        if own:
            return own[pick % len(own)]
    raise ValueError("no model is configured")


def byte_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, offset, line_hash): where each line of the .jsonl files begins. A
    file is one task's work here, read as a stream of lines; line_hash alone is the
    better pointer."""
    import hashlib
    import io
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    def batch(name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["file_path", "offset", "line_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with io.BufferedReader(system.open_input_stream(own, compression=None), 1 << 20) as source:
                    at, rows = 0, []
                    for line in source:
                        rows.append((at, hashlib.md5(line.rstrip(b"\r\n") + b"\n").hexdigest()))
                        at += len(line)
                        if len(rows) == 10_000:
                            yield batch(name, rows)
                            rows = []
                    yield batch(name, rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").load(path)
    return files.select("path").mapInArrow(run, "file_path string, offset bigint, line_hash string")
