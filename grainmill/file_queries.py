"""Queries that write files and read them back, and those of operators that ask a
model (a stub that answers by rule). Registered with their SQL by grainmill.queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import streaming
from grainmill.functions import recipe as R
from grainmill.functions import text as T
from grainmill.operators import cleaning, conversations, mixing, model_calls, packing
from grainmill.operators import distributions as D
from grainmill.operators.components import scratch_path
from grainmill.operators.recipe import condition
from grainmill.queries import _CAP, _META, ORACLES, TARGETS, meta, query, rounded, rounded_number, table, uniform_sql
from grainmill.sources import readers, sinks


def write_files(rows: DataFrame, out: str, place: Column | None = None, places: int = 32) -> str:
    """Files of given names: rows is (name, value), a line each. A file is one task's work, written as its lines come;
    place is a number below `places` by name, to have one file a task where the names are known."""
    own = place if place is not None else F.pmod(F.xxhash64("name"), F.lit(places))
    sinks.write_named(rows.repartitionById(places, own.cast("int")).select("name", "value").sortWithinPartitions("name"), out)
    return out


def corpus(spark: SparkSession, d: str, broken: bool = False) -> str:
    """Documents as JSON lines in a tree of files with odd names; broken: every seventh line is cut."""
    docs = table(spark, d, "documents")
    own = F.struct("source", F.lit("c").alias("category"), F.lit("d").alias("domain"), F.col("lang").alias("language"), F.col("n_chars").alias("token_count"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", own.alias("metadata")))
    line = F.when(F.col("doc_id") % 7 == 0, F.substring(line, 1, 15)).otherwise(line) if broken else line
    name = F.concat(F.lit("s"), F.col("doc_id") % 3, F.lit("/deep/x"), F.col("doc_id") % 5, F.when(F.col("doc_id") % 2 == 0, ".jsonl").otherwise(".JSONL"))
    place = F.pmod("doc_id", F.lit(30))
    rows = docs.select(name.alias("name"), line.alias("value"), place.alias("place"))
    other = docs.where("doc_id < 3").select(F.concat(F.lit("s0/y"), F.col("doc_id"), F.when(F.col("doc_id") == 0, "_F.jsonl").otherwise(".txt")).alias("name"), line.alias("value"), F.lit(30).alias("place"))
    return write_files(rows.union(other), scratch_path(spark, "corpus"), F.col("place"), 31)


# --- sources ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def jsonl_discovery(spark, d):
    lines = readers.json_lines(spark, corpus(spark, d), exclude_suffix="_F.jsonl")
    return lines.select(F.from_json("value", "id string, text string").alias("o")).select("o.*")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 7 <> 0")
def tolerant_reader(spark, d):
    return readers.tolerant(spark, corpus(spark, d, broken=True), "id string, text string", exclude_suffix="_F.jsonl")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, lang AS language, n_chars AS token_count FROM documents UNION ALL SELECT '0', source, lang, n_chars FROM documents WHERE doc_id = 0")
def metadata_index(spark, d):
    return readers.load_mix(spark, corpus(spark, d)).select("id", "source", "language", "token_count")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE text END AS text, CASE doc_id % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'other_id' ELSE 'ok' END AS status FROM documents WHERE doc_id > 0")
def verified_fetch(spark, d):
    path = corpus(spark, d)
    n = F.col("id").cast("bigint")
    want = readers.load_mix(spark, path).where("id != '0'").withColumn("line_hash", F.when(n % 4 == 1, "none").otherwise(F.col("line_hash")))
    asked = want.select(F.when(n % 4 == 2, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), "file_path", "line_hash")
    return readers.verified_texts(asked, readers.json_lines(spark, path)).select(F.regexp_replace("id", "x", "").alias("id"), "text", "status")


@query("SELECT count(*) + 1 AS n, 0 AS least FROM documents")
def line_offsets(spark, d):
    """As many offsets as lines, each at the beginning of a line that the index knows."""
    path = corpus(spark, d)
    index = readers.load_mix(spark, path).select("line_hash").distinct()
    return readers.byte_offsets(spark, path).join(index, "line_hash", "left_semi").agg(F.count("*").alias("n"), F.min("offset").cast("int").alias("least"))


@query("SELECT doc_id, text, 'x' || CAST(doc_id % 2 AS VARCHAR) AS folder FROM documents")
def parquet_scan(spark, d):
    out = scratch_path(spark, "parquet")
    table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 2).alias("part")).write.partitionBy("part").parquet(f"{out}/in")
    got = readers.parquet(spark, out)
    return got.select("doc_id", "text", F.concat(F.lit("x"), F.regexp_extract("file_path", r"part=(\d)", 1)).alias("folder"))


@query("SELECT '# ' || CAST(item_id AS VARCHAR) || chr(10) || text || chr(10) AS text FROM benchmark")
def markdown_folder(spark, d):
    rows = table(spark, d, "benchmark").select(F.concat("item_id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "item_id", F.lit("\n"), "text").alias("value"))
    other = rows.select(F.concat(F.lit("sub/"), "name").alias("name"), "value")
    return readers.markdown(spark, write_files(rows.union(other), scratch_path(spark, "markdown"))).select("text")


@query("SELECT lang, least(count(*), CASE lang WHEN 'en' THEN 100 ELSE 20 END) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY 1")
def training_mix(spark, d):
    docs = table(spark, d, "documents")
    return readers.training_mix([(docs.where("lang = 'en'"), 100), (docs.where("lang = 'de'"), 20)]).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT substr(text, 1, 100) AS value FROM documents ORDER BY doc_id LIMIT 3")
def preview(spark, d):
    return readers.preview(table(spark, d, "documents").orderBy("doc_id").select(F.col("text").alias("value")))


@query("SELECT true AS is_dir, count(DISTINCT (doc_id % 3, doc_id % 5, doc_id % 2)) + 1 AS files, count(DISTINCT (doc_id % 3, doc_id % 5, doc_id % 2)) AS kept FROM documents")
def path_diagnostics(spark, d):
    path = corpus(spark, d)
    lower = readers.diagnose(spark, path, ".jsonl")
    upper = readers.diagnose(spark, path, ".JSONL")
    kept = [x for x in readers.tree(spark, path, ignore_files=["y0_F.jsonl"])[1] if x.lower().endswith(".jsonl")]
    return spark.createDataFrame([(lower["is_dir"], lower["files"] + upper["files"], len(kept))], "is_dir boolean, files bigint, kept bigint")


# --- sinks ------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, out: str, schema: str, *more: str) -> DataFrame:
    return spark.read.text(out).select(*more, F.from_json("value", schema).alias("o")).select(*more, "o.*")


@query(f"WITH a AS ({ORACLES['shard_assign']}) SELECT shard, doc_id, text FROM a JOIN documents USING (doc_id)".replace("WITH a AS (WITH RECURSIVE", "WITH RECURSIVE a AS (WITH RECURSIVE"))
def write_shards(spark, d):
    out = scratch_path(spark, "shards")
    sinks.write_shards(table(spark, d, "documents").select("doc_id", "text"), out, _CAP, "doc_id", packing.text_bytes(), exact=True)
    return _lines(spark, out, "doc_id bigint, text string", "shard").select(F.col("shard").cast("bigint").alias("shard"), "doc_id", "text")


@query("SELECT lang, text FROM documents UNION ALL SELECT lang, text FROM documents")
def write_shards_of_copies(spark, d):
    """Every line twice, ordered by a column that repeats."""
    docs, out = table(spark, d, "documents").select("lang", "text"), scratch_path(spark, "shards")
    sinks.write_shards(docs.union(docs), out, _CAP, "lang")
    return _lines(spark, out, "lang string, text string")


@query(f"SELECT count(*) AS over FROM documents WHERE strlen(text) + 1 > {_CAP}")
def shards_within_cap(spark, d):
    """Shards over the cap hold one row each, and it is as long as that."""
    docs, out = table(spark, d, "documents").select("doc_id", "text"), scratch_path(spark, "shards")
    plan = sinks.write_shards(docs, out, _CAP, "doc_id", packing.text_bytes())
    return plan.groupBy("shard").agg(F.sum("bytes").alias("b")).where(F.col("b") > _CAP).agg(F.count("*").alias("over"))


@query("SELECT doc_id, source, text FROM documents WHERE lang = 'en'")
def streaming_shards(spark, d):
    """Lines arrive as a stream, are sampled by weights of 0 and 1, and written as shards."""
    out = scratch_path(spark, "stream")
    lines = streaming.json_lines(spark, corpus(spark, d), files_per_trigger=8).where("file_path not like '%\\_F.jsonl'")
    rows = streaming.sampled(lines, {"language": {"en": 1.0, "de": 0.0, "fr": 0.0, "es": 0.0}})
    streaming.export(rows.select("id", "source", "text", "line_hash"), f"{out}/data", _CAP, "line_hash", f"{out}/checkpoint").awaitTermination()
    got = _lines(spark, f"{out}/data", "id string, source string, text string")
    return got.select(F.col("id").cast("bigint").alias("doc_id"), "source", "text")


@query("SELECT lang || '/' || source || '.parquet' AS src_file, doc_id, text FROM documents")
def mirrored_files(spark, d):
    out = scratch_path(spark, "mirror")
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("file:///data/"), "lang", F.lit("/"), "source", F.lit(".parquet"))
    sinks.write_mirrored(docs.select("doc_id", "text", path.alias("file_path")), out, root="/data")
    return _lines(spark, out, "doc_id bigint, text string", "src_file")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def size_split_dataset(spark, d):
    out = scratch_path(spark, "dataset")
    sinks.write_limited(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), out, 100)
    return readers.dataset(spark, out)


@query("SELECT item_id, text FROM benchmark")
def files_by_id(spark, d):
    out = scratch_path(spark, "items")
    sinks.write_by_id(table(spark, d, "benchmark").select("item_id", "text"), out, "item_id")
    return _lines(spark, out, "text string", "item").select(F.col("item").cast("bigint").alias("item_id"), "text")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE quality = 1")
def merged_parts(spark, d):
    out = scratch_path(spark, "merged")
    for part in (table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "labels").where("quality = 1").select("doc_id", "quality")):
        sinks.merge_parts(part, out)
    return spark.read.schema("doc_id bigint, quality int").json(out)


# a text without headings, formulas and long lines is one chunk: kept, unless it is long enough and full of signs
_PLAIN = "length(text) <= 2000 AND NOT contains(text, '$') AND NOT contains(text, chr(92)) AND NOT contains(text, '!') AND NOT regexp_matches(text, '(^|\\n)\\s*#')"
_ODD = r"length(text) >= 20 AND len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / length(text) > 0.35"


def _cleaned(spark, d):
    rows = table(spark, d, "documents").where(F.expr(_PLAIN.replace("regexp_matches(text, '(^|\\n)\\s*#')", r"regexp_like(text, '(^|\\n)\\s*#')").replace("chr(92)", "char(92)")))
    more = F.when(F.col("doc_id") % 5 == 0, F.lit("; - / % & = + * ' ( ) " * 20)).otherwise("")
    rows = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("![a](b.png)"), "text", more).alias("text"))
    out = scratch_path(spark, "cleaned")
    sinks.write_cleaned(*cleaning.clean(rows), out)
    return out


_CLEAN = f"WITH t AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 5 = 0 THEN repeat('; - / % & = + * '' ( ) ', 20) ELSE '' END AS text FROM documents WHERE {_PLAIN}) "
_FITS = "length(text) <= 2048"


@query(_CLEAN + f"SELECT id, CASE WHEN {_ODD} THEN '' ELSE text END AS text FROM t WHERE {_FITS}")
def cleaned_output(spark, d):
    got = spark.read.schema("id bigint, text string").json(f"{_cleaned(spark, d)}/cleaned")
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.length("text") + F.when(F.col("doc_id") % 5 == 0, 440).otherwise(0)).alias("n"))
    return got.join(sizes, "id").where("n <= 2048").select("id", "text")


@query(_CLEAN + f"SELECT id, 'special characters' AS flag, text FROM t WHERE {_ODD} AND {_FITS}")
def reject_log(spark, d):
    got = spark.read.schema("id bigint, flag string, text string").json(f"{_cleaned(spark, d)}/rejects")
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.length("text") + F.when(F.col("doc_id") % 5 == 0, 440).otherwise(0)).alias("n"))
    return got.join(sizes, "id").where("n <= 2048").select("id", "flag", "text")


def upper_letter(c: str) -> str:
    """One character's upper case that is one character, as in SQL: ß is ẞ, ŉ stays; str.upper() would give SS and ʼN."""
    made = (c.upper(), "ẞ" if c == "ß" else c.title())
    return next((x for x in made if len(x) == 1), c)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE upper(substr(text, 1, 1)) || CAST(length(text) AS VARCHAR) END AS text, CASE WHEN doc_id % 3 = 0 THEN 'error: ValueError: odd' ELSE 'ok' END AS status FROM documents")
def guarded_transform(spark, d):
    """A transform that fails on every third text passes those through."""

    def f(t: str) -> str:
        n, _, own = t.partition("|")
        if int(n) % 3 == 0:
            raise ValueError("odd")
        return upper_letter(own[:1]) + str(len(own))

    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), "text").alias("text"))
    return cleaning.guarded(docs, f).select("doc_id", F.regexp_replace("text", r"^\d+\|", "").alias("text"), "status")


# --- labelling and viewer formats -------------------------------------------------------------------------------------

_ID = "substr(sha256({} || '|' || CAST({} AS VARCHAR)), 1, 32)"
_TURNS = "t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations), "


@query(
    "WITH " + _TURNS + "u AS (SELECT conv_id, arg_min(text, k) AS prompt FROM t WHERE role = 'user' GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS i FROM t WHERE text <> '') "
    f"SELECT conv_id, prompt, {_ID.format('CAST(conv_id AS VARCHAR)', 'i')} AS message_id, text AS content, CASE WHEN role = 'user' THEN 'send' ELSE 'receive' END AS message_type, "
    f"CASE WHEN role = 'user' THEN 'q' ELSE 'a' END AS user_id, CASE WHEN i > 0 THEN {_ID.format('CAST(conv_id AS VARCHAR)', 'i - 1')} END AS parent_id FROM n LEFT JOIN u USING (conv_id)"
)
def labelling_format(spark, d):
    own = conversations.gather(table(spark, d, "conversations")).withColumns({"query_source": F.lit("q"), "answer_source": F.lit("a")})
    return conversations.to_labelling(own, "conv_id").select("conv_id", "prompt", F.explode("conversation").alias("m")).select("conv_id", "prompt", "m.*")


# records whose first query begins alike are one; assistants' texts have a think block, which becomes headed sections
_SHOWN = "CASE WHEN role = 'assistant' THEN '## Reasoning' || chr(10) || 'r' || chr(10) || chr(10) || '## Answer' || chr(10) || substr(text, 1, 9) || 'x' ELSE text END"


@query(
    "WITH " + _TURNS + f"s AS (SELECT conv_id, k, role, {_SHOWN} AS content FROM t WHERE NOT (role <> 'assistant' AND text = '')), "
    "q AS (SELECT conv_id, substr(arg_min(text, k), 1, 1) AS query FROM t WHERE role = 'user' GROUP BY 1), l AS (SELECT query, min(conv_id) AS lead FROM q GROUP BY 1), "
    "a AS (SELECT query, s.*, conv_id = lead AS is_lead FROM s JOIN q USING (conv_id) JOIN l USING (query) WHERE query <> ''), "
    "h AS (SELECT query, content, role, conv_id, k, 0 AS grp FROM a WHERE is_lead), "
    "f AS (SELECT query, content, role, conv_id, k, 1 AS grp, row_number() OVER (PARTITION BY query, content ORDER BY conv_id, k) AS nth FROM a WHERE NOT is_lead AND NOT EXISTS (SELECT 1 FROM h WHERE h.query = a.query AND h.content = a.content)), "
    "m AS (SELECT query, content, role, conv_id, row_number() OVER (PARTITION BY query ORDER BY grp, conv_id, k) - 1 AS i FROM (SELECT * FROM h UNION ALL SELECT * EXCLUDE (nth) FROM f WHERE nth = 1)) "
    f"SELECT query, lead AS file_path, {_ID.format('query', 'i')} AS message_id, content, CASE WHEN role = 'user' THEN 'send' ELSE 'receive' END AS message_type, "
    f"CASE WHEN role = 'user' THEN 'q' || CAST(conv_id AS VARCHAR) ELSE 'a' END AS user_id, CASE WHEN i > 0 THEN {_ID.format('query', 'i - 1')} END AS parent_id FROM m JOIN l USING (query)"
)
def label_records(spark, d):
    own = conversations.gather(table(spark, d, "conversations"))
    shown = lambda m: F.when(m.role == "assistant", F.concat(F.lit("<think>r</think>"), F.substring(m.content, 1, 9), F.lit("x"))).otherwise(m.content)
    own = own.withColumn("key", F.substring(conversations.first_query(F.col("messages")), 1, 1)).withColumn("messages", F.transform("messages", lambda m: F.struct(m.role.alias("role"), shown(m).alias("content"))))
    own = own.withColumns({"query_source": F.concat(F.lit("q"), "conv_id"), "answer_source": F.lit("a"), "file_path": F.col("conv_id")})
    got = conversations.merge_labelling(own, "conv_id", key=F.col("key"))
    out = scratch_path(spark, "labelling")
    sinks.write_limited(got, out, 50)
    back = spark.read.schema(got.schema).json(out)
    return back.select("query", F.col("custom.file_path").cast("bigint").alias("file_path"), F.explode("conversation").alias("m")).select("query", "file_path", "m.*")


_VIEW = (
    "WITH " + _TURNS + "n AS (SELECT *, 1 + coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM t) "
    "SELECT conv_id, string_agg('## ' || CASE WHEN role = 'user' THEN 'Question ' ELSE 'Answer ' END || CAST(r AS VARCHAR) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS out FROM n GROUP BY 1"
)


@query(_VIEW)
def conversation_markdown(spark, d):
    return conversations.gather(table(spark, d, "conversations")).select("conv_id", conversations.as_markdown(F.col("messages")).alias("out"))


@query(_VIEW.replace("AS out", "|| chr(10) AS out"))
def markdown_export(spark, d):
    out = scratch_path(spark, "views")
    sinks.write_markdown(conversations.gather(table(spark, d, "conversations")), out, "conv_id")
    return spark.read.text(out, wholetext=True).select(F.col("item").cast("bigint").alias("conv_id"), F.col("value").alias("out"))


# --- recipe steps without a query so far ------------------------------------------------------------------------------

_FIXED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'café ' ELSE 'Ä é ' END || CAST(doc_id AS VARCHAR) AS out FROM documents"


@query(_FIXED)
def fix_unicode(spark, d):
    """UTF-8 read as Latin-1, and letters with combining marks."""
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "cafÃ© ").otherwise("Ä é "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", R.fix_unicode(t).alias("out"))


_SPACED = "SELECT doc_id, 'a b c d e f g ' || text AS out FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS text FROM documents)"


@query(_SPACED)
def every_space(spark, d):
    odd = F.lit(" a b c d e f​g ").cast("string")
    return table(spark, d, "documents").select("doc_id", R.normalise_whitespace(F.concat(F.regexp_replace(odd, " ", "　"), F.col("doc_id").cast("string"), F.lit(" "))).alias("out"))


_GRAMS = (
    "WITH g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 8, 1)), lambda i: substr(text, i, 10))) AS gram FROM documents), "
    "c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM c), "
    "s AS (SELECT doc_id, sum(n) AS total, floor(sqrt(count(*))) AS most, count(*) FILTER (n > 1) AS repeated FROM c GROUP BY 1), "
    "r AS (SELECT doc_id, any_value(total) AS total, coalesce(sum(n) FILTER (k <= least(most, repeated)), 0) AS top FROM o JOIN s USING (doc_id) GROUP BY 1), "
    "f AS (SELECT doc_id, coalesce(top / total, 0) AS v FROM documents LEFT JOIN r USING (doc_id)) "
)


@query(_GRAMS + "SELECT doc_id, round(v, 9) AS out FROM f")
def stat_character_repetition_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(R.character_repetition(F.col("text"))).alias("out"))


@query(_GRAMS + "SELECT doc_id FROM f WHERE v <= 0.3")
def character_repetition_filter(spark, d):
    return table(spark, d, "documents").where(condition("character_repetition_filter", F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM ({ORACLES['stat_word_repetition_filter']}) WHERE out <= 0.2962")
def word_repetition_filter(spark, d):
    return table(spark, d, "documents").where(condition("word_repetition_filter", F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM ({ORACLES['stat_flagged_words_filter']}) WHERE out <= 0.0015")
def flagged_words_filter(spark, d):
    return table(spark, d, "documents").where(condition("flagged_words_filter", F.col("text"), {"words": ("idiot", "moron", "scum")})).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (n_chars % 100) / 100 >= 0.793")
def language_id_score_filter(spark, d):
    return table(spark, d, "documents").withColumn("lang_score", (F.col("n_chars") % 100) / 100).where(condition("language_id_score_filter", F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars * 10 <= 5000")
def perplexity_filter(spark, d):
    return table(spark, d, "documents").withColumn("perplexity", F.col("n_chars") * 10).where(condition("perplexity_filter", F.col("text"))).select("doc_id")


# --- chunks -----------------------------------------------------------------------------------------------------------

_AT = "CASE WHEN contains(substr(rest, 1, 2048), chr(10)) THEN 2049 - strpos(reverse(substr(rest, 1, 2048)), chr(10)) WHEN contains(substr(rest, 1, 2048), ' ') THEN 2049 - strpos(reverse(substr(rest, 1, 2048)), ' ') ELSE 2048 END"


@query(
    "WITH RECURSIVE t AS (SELECT doc_id, '# one' || chr(10) || text AS rest, 0 AS pos, '' AS chunk FROM documents WHERE NOT contains(text, '$') UNION ALL "
    f"SELECT doc_id, CASE WHEN length(rest) > 2048 THEN substr(rest, {_AT} + 1) ELSE '' END, pos + 1, CASE WHEN length(rest) > 2048 THEN substr(rest, 1, {_AT}) ELSE rest END FROM t WHERE rest <> '') "
    "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, chunk FROM t WHERE pos > 0"
)
def markdown_chunks(spark, d):
    from grainmill.functions.markdown import heading_chunks

    docs = table(spark, d, "documents").where("not contains(text, '$')")
    return docs.select("doc_id", F.posexplode(heading_chunks(F.concat(F.lit("# one\n"), F.col("text")))).alias("pos", "chunk"))


_WORDS = r"len(regexp_extract_all(text, '[一-鿿]|[^\s一-鿿]+'))"


@query(
    f"SELECT substr(sha256(CAST(doc_id AS VARCHAR) || '|0|' || md5(text)), 1, 32) AS id, text, CAST({_WORDS} AS INTEGER) AS text_length, "
    f"CASE WHEN trim(text) = '' OR len(regexp_extract_all(text, '[一-鿿]')) / greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) > 0.3 THEN 'CN' ELSE 'EN' END AS language, CAST(doc_id AS VARCHAR) AS file_path "
    f"FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN repeat('中文字', 30) ELSE text END AS text FROM documents) WHERE {_WORDS} BETWEEN 50 AND 400"
)
def short_token_chunks(spark, d):
    """Texts that are one chunk: ids, counts and language labels."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.when(F.col("doc_id") % 6 == 0, F.repeat(F.lit("中文字"), F.lit(30))).otherwise(F.col("text")).alias("text"))
    docs = docs.where(T.approximate_tokens(F.col("text")) <= 400)
    return cleaning.chunks(docs, least=50, most=400)


@query("SELECT conv_id, CASE WHEN u < 2 THEN n + 1 ELSE n END AS n, CASE WHEN u < 2 THEN 'and then?' ELSE last END AS last FROM (SELECT conv_id, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (role = 'user') AS u, arg_max(text, (turn, role, text)) AS last FROM conversations GROUP BY 1)")
def added_questions(spark, d):
    own = conversations.gather(table(spark, d, "conversations")).select("conv_id", conversations.add_question(F.col("messages"), "and then?", most=2).alias("m"))
    return own.select("conv_id", F.size("m").alias("n"), F.get("m", F.size("m") - 1).content.alias("last"))


@query("SELECT * FROM (VALUES ('p', CAST(NULL AS VARCHAR)), ('q', 'concurrency must be a positive integer'), ('r', 'unknown model_type'), ('s', 'missing: api_key')) t(path, why)")
def model_configurations(spark, d):
    text = json.dumps({"models": [dict(api_path=p, model_name="m", api_key=k, **more) for p, k, more in (("p", "k", {}), ("q", "k", {"concurrency": 0}), ("r", "k", {"model_type": "x"}), ("s", "", {}))]})
    return spark.createDataFrame([(m["api_path"], readers.invalid_model(m)) for m in readers.models(text)], "path string, why string")


# --- drawing and fitting ----------------------------------------------------------------------------------------------


_ROUNDS = f"CAST(least(CASE WHEN {uniform_sql('doc_id')} < 0.8 THEN 0 ELSE least(floor(({uniform_sql('doc_id')} - 0.8) / {0.2 / 6!r}) + 1, 6) END, 6) AS INTEGER)"


@query(f"SELECT doc_id, {_ROUNDS} AS rounds, CAST(floor({uniform_sql('doc_id', 1)} * 3) AS INTEGER) AS endpoint FROM documents")
def follow_up_rounds(spark, d):
    return table(spark, d, "documents").select("doc_id", T.rounds(F.col("doc_id")).alias("rounds"), model_calls.endpoint(F.col("doc_id"), 3).alias("endpoint"))


_CASE = "CASE language WHEN 'en' THEN 0.1 WHEN 'de' THEN 0.3 ELSE 0.05 END"
_DRAWN = (
    _META + f", x AS (SELECT *, {uniform_sql('doc_id')} AS u, {uniform_sql('doc_id', 1)} AS u1, {_CASE} AS weight FROM m), y AS (SELECT *, u < least(weight, 1) AS taken FROM x), "
    "z AS (SELECT coalesce(sum(token_count) FILTER (taken), 0) AS got, sum(token_count) FILTER (NOT taken) AS rest FROM y) "
)


def _sample(top_up: str):
    def run(spark, d):
        w = F.when(F.col("language") == "en", 0.1).when(F.col("language") == "de", 0.3).otherwise(0.05)
        rows = D.with_bin(meta(spark, d)).withColumn("weight", w)
        return mixing.sample(rows, 400_000.0, "doc_id", top_up=top_up).select("doc_id", "language", "token_count")

    return run


query(_DRAWN + "SELECT doc_id, language, token_count FROM y, z WHERE taken OR (got < 380000 AND u1 < (400000 - got) / rest AND token_count > 0)", "sample_level")(_sample("level"))
query(_DRAWN + "SELECT doc_id, language, token_count FROM y, z WHERE taken OR (got < 380000 AND u1 < least((400000 - got) / rest * token_count, 1) AND token_count > 0)", "sample_steep")(_sample("steep"))
query(_DRAWN + "SELECT doc_id, language, token_count FROM y WHERE taken", "sample_once")(_sample("none"))

_TARGET_ROWS = "VALUES " + ", ".join(f"('{a}', '{v}', CAST({x} AS DOUBLE))" for a, own in TARGETS.items() for v, x in own.items())


@query(
    _META + f", t(dim, value, ratio) AS ({_TARGET_ROWS}), s AS (SELECT 'language' AS dim, language AS value, count(*) / (SELECT count(*) FROM m) AS share FROM m GROUP BY 2 UNION ALL SELECT 'category', category, count(*) / (SELECT count(*) FROM m) FROM m GROUP BY 2) "
    "SELECT dim, value, round(CASE WHEN share IS NULL THEN 0 ELSE least(greatest(ratio / (share + 1e-8), 0.1), 10) END, 9) AS factor FROM t LEFT JOIN s USING (dim, value)"
)
def mixing_factors(spark, d):
    f = mixing.factors(mixing.shares(meta(spark, d), list(TARGETS), by_rows=True), TARGETS)
    return spark.createDataFrame([(a, v, rounded_number(float(x))) for a, own in f.items() for v, x in own.items()], "dim string, value string, factor double")


@query("SELECT count(*) FILTER (quality = 1) AS done, count(*) FILTER (quality <> 1) AS failed FROM labels")
def run_outcomes(spark, d):
    return D.outcomes(table(spark, d, "labels"), F.col("quality") == 1, "toxic", "doc_id")[0]


# --- operators that ask a model ---------------------------------------------------------------------------------------


def _stub():
    """Answers by rule: verdicts and scores by the number in the prompt."""

    def client(messages: list[dict]) -> str:
        prompt = messages[-1]["content"]
        n = int((re.search(r"#(\d+)", prompt) or [0, 0])[1])
        kind = prompt[:2]
        if kind == "QF":
            return "<think>hm</think>" + json.dumps({"is_filter": n % 3 == 0, "reason": f"q{n}"})
        if kind == "AF":
            return f"```json\n{{'is_filter': {'true' if n % 5 == 0 else 'false'}, 'reason': 'a{n}',}}\n```"
        if kind == "QS":
            return json.dumps({"score": n % 10, "reason": "s"}) if n % 7 else "no object"
        if kind == "AS":
            return f"one #{n}\n\ntwo #{n}\n"
        if kind == "AN":
            return f"<think>thought #{n}</think>answer #{n}"
        return f"{kind} #{n}"

    return client


_PROMPTS = {
    "question": "ASK {n} {text}", "answer": "AN {question}", "follow_up": "FO {text}", "rewrite": "RW {answer}",
    "question_filter": "QF {question}", "answer_filter": "AF {qa_pair}", "qa_score": "QS {qa_pair} {ref_paper}",
}


def _items(spark, d):
    message = F.array(
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("q #"), "doc_id").alias("content"), F.lit(None).cast("string").alias("think"), F.lit(None).cast("string").alias("answer")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.lit("t").alias("think"), F.lit("a").alias("answer")),
    )
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("text").alias("text"), message.alias("messages"))


@query("SELECT doc_id AS id, CAST(doc_id % 10 AS DOUBLE) AS score FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 10 > 5")
def model_filters_kept(spark, d):
    return model_calls.filtered(_items(spark, d), _stub, _PROMPTS)[0].select("id", "score")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'question_filter' WHEN doc_id % 5 = 0 THEN 'answer_filter' ELSE 'qa_score' END AS filter, "
    "CASE WHEN doc_id % 3 = 0 THEN 'q' || doc_id WHEN doc_id % 5 = 0 THEN 'a' || doc_id WHEN doc_id % 7 = 0 THEN NULL ELSE 's' END AS reason, "
    "CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0.0 ELSE CAST(doc_id % 10 AS DOUBLE) END AS score "
    "FROM labels WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 10 <= 5"
)
def model_filters_rejects(spark, d):
    return model_calls.filtered(_items(spark, d), _stub, _PROMPTS)[1]


_N = "WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, " + _ROUNDS + " AS r FROM labels), k AS (SELECT unnest([0, 1]) AS question_no, unnest(['one', 'two']) AS word) "


@query(
    _N + ", t AS (SELECT unnest(['dialogue', 'max_question', 'max_filter', 'plus_answer']) AS task) SELECT id, CAST(question_no AS INTEGER) AS question_no, task, CAST(CASE WHEN task = 'plus_answer' THEN 2 ELSE 2 * (r + 1) END AS INTEGER) AS turns, "
    "CASE task WHEN 'dialogue' THEN word || ' #' || id WHEN 'max_question' THEN 'ASK 1 text #' || id WHEN 'max_filter' THEN 'RW answer #' || id ELSE 'AN ' || word || ' #' || id END AS first, "
    "CASE task WHEN 'dialogue' THEN 'answer #' || id WHEN 'max_question' THEN CASE WHEN r > 0 THEN 'FO #' || id ELSE 'one #' || id || chr(10) || chr(10) || 'two #' || id END WHEN 'max_filter' THEN 'RW #' || id "
    "ELSE '<think>' || chr(10) || 'thought #' || id || chr(10) || '</think>' || chr(10) || chr(10) || 'answer #' || id END AS last FROM n, k, t"
)
def model_dialogues(spark, d):
    items = table(spark, d, "labels").select("doc_id", F.concat(F.lit("text #"), "doc_id").alias("text"), F.lit(10).alias("text_length"))
    got = model_calls.dialogues(items, _stub, _PROMPTS, id_col="doc_id")
    end = F.get("messages", F.size("messages") - 1)
    return got.select("id", "question_no", "task", F.size("messages").alias("turns"), F.get("messages", F.lit(0)).content.alias("first"), F.coalesce(end.answer, end.content).alias("last"))


@query(
    _N + "SELECT id, CAST(question_no AS INTEGER) AS question_no, CASE WHEN doc_id % 5 = 0 OR (doc_id % 7 <> 0 AND doc_id % 10 <= 5) THEN 'rejected' ELSE 'dialogue' END AS task, "
    "CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 10.0 ELSE CAST(doc_id % 10 AS DOUBLE) END AS score, CAST(2 * (r + 1) AS INTEGER) AS turns FROM n, k WHERE NOT (doc_id % 3 = 0 AND question_no = 1)"
)
def model_distil(spark, d):
    """Filters inside the loop; where the question filter rejects both, the first stays."""
    items = table(spark, d, "labels").select("doc_id", F.concat(F.lit("text #"), "doc_id").alias("text"), F.lit(10).alias("text_length"))
    got = model_calls.distil(items, _stub, _PROMPTS, ("question_filter", "answer_filter", "qa_score"), id_col="doc_id")
    return got.select("id", "question_no", "task", "score", F.size("messages").alias("turns"))


@query("SELECT doc_id, 't #' || doc_id AS think, 'a #' || doc_id AS answer FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '', 'a #' || doc_id FROM labels WHERE doc_id % 2 = 1")
def model_ask(spark, d):
    def factory():
        return lambda m: f"<think>t {m[0]['content']}</think>a {m[0]['content']}" if int(m[0]["content"][1:]) % 2 == 0 else f"<think>a {m[0]['content']}"

    rows = table(spark, d, "labels").select("doc_id")
    asked = model_calls.ask(rows, F.array(model_calls.message("user", F.concat(F.lit("#"), F.col("doc_id").cast("string")))), factory)
    return asked.select("doc_id", "reply.think", "reply.answer")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'q' || doc_id END AS question, CASE WHEN doc_id % 3 = 0 THEN 'causal' END AS type FROM labels")
def reasoning_questions(spark, d):
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('x {"question": "q'), "doc_id", F.lit('", "answer": "a", "type": "causal"}'))).when(F.col("doc_id") % 3 == 1, "{}").otherwise('{"question": "q", "answer": "a", "type": "odd"}')
    q = model_calls.reasoning_question(reply)
    return table(spark, d, "labels").select("doc_id", q.question.alias("question"), q.getField("type").alias("type"))
