"""Registered queries over the driver's tables and their SQL.

The mixing queries see documents as a corpus index: category and domain come from
labels, token_count is the number of characters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import recipe as R
from grainmill.functions import text as T
from grainmill.functions.bins import LABELS, subclass_key, token_bin
from grainmill.functions.markdown import tables_to_markdown, trimmed_paper
from grainmill.operators import cleaning, conversations, mixing, model_calls, packing, simhash
from grainmill.operators import distributions as D
from grainmill.operators.recipe import FILTERS, condition
from grainmill.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus index; labels are small beside documents but grow with them: Catalyst picks the join."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda p, c: F.coalesce(F.concat(F.lit(p), F.col(c).cast("string")), F.lit("unlabeled"))
    return d.join(lab, "doc_id", "left").select("doc_id", "source", part("q", "quality").alias("category"), part("t", "toxic").alias("domain"), F.col("lang").alias("language"), F.col("n_chars").alias("token_count"), "text")


def _bin(n: str, edges: tuple[int, ...] = (4096, 8192, 16384, 32768), op: str = "<", first: str = "") -> str:
    return f"CASE WHEN {n} IS NULL THEN NULL {first} " + " ".join(f"WHEN {n} {op} {e} THEN '{x}'" for e, x in zip(edges, LABELS)) + f" ELSE '{LABELS[-1]}' END"


_G2 = _bin("token_count", first=f"WHEN token_count < 0 THEN '{LABELS[-1]}'")
_META = f"""WITH m0 AS (SELECT d.doc_id, d.source, coalesce('q' || CAST(l.quality AS VARCHAR), 'unlabeled') AS category,
  coalesce('t' || CAST(l.toxic AS VARCHAR), 'unlabeled') AS domain, d.lang AS language, d.n_chars AS token_count, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT *, {_G2} AS token_bin FROM m0) """


def rounded(x: Column, digits: int = 9) -> Column:
    """A double rounded as SQL does it: multiplied, rounded half away from 0, divided. F.round
    goes by the printed number instead, and differs where the product just misses a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def rounded_number(x: float, digits: int = 9) -> float:
    """rounded() of a number of the driver's."""
    part, whole = math.modf(abs(x) * 10.0**digits)
    return math.copysign((whole + (part >= 0.5)) / 10.0**digits, x)


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


# --- bins and distributions -------------------------------------------------------------------------------------------


@query(_META + "SELECT doc_id, token_count, token_bin FROM m")
def token_bin_binary(spark, d):
    return meta(spark, d).select("doc_id", "token_count", token_bin(F.col("token_count")).alias("token_bin"))


@query(_META + f"SELECT doc_id, token_count, {_bin('token_count', (4000, 8000, 16000, 32000), '<=')} AS token_bin FROM m0")
def token_bin_decimal(spark, d):
    return meta(spark, d).select("doc_id", "token_count", token_bin(F.col("token_count"), "decimal").alias("token_bin"))


for _d in D.DIMENSIONS:
    query(_META + f"SELECT {_d}, round(sum(token_count) / (SELECT sum(token_count) FROM m WHERE {_d} IS NOT NULL), 9) AS share FROM m WHERE {_d} IS NOT NULL GROUP BY 1", f"dist_{_d}")(
        lambda spark, d, _d=_d: _rounded(D.distribution(D.with_bin(meta(spark, d)), _d), "share")
    )
    query(_META + f"SELECT {_d}, count(*) AS n, round(count(*) / (SELECT count(*) FROM m WHERE {_d} IS NOT NULL), 9) AS share FROM m WHERE {_d} IS NOT NULL GROUP BY 1", f"rowdist_{_d}")(
        lambda spark, d, _d=_d: _rounded(D.row_distribution(D.with_bin(meta(spark, d)), _d), "share")
    )

_ALL = " UNION ALL ".join(f"SELECT '{x}' AS dim, {x} AS value, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS n, round(sum(token_count) / (SELECT sum(token_count) FROM m WHERE {x} IS NOT NULL), 9) AS share FROM m WHERE {x} IS NOT NULL GROUP BY 2" for x in D.DIMENSIONS)


@query(_META + _ALL)
def dist_all(spark, d):
    return _rounded(D.distributions(meta(spark, d)), "share")


@query(_META + "SELECT b.token_bin, b.ordinal, round(coalesce(sum(token_count), 0) / (SELECT sum(token_count) FROM m), 9) AS share FROM (VALUES " + ", ".join(f"('{x}', {k})" for k, x in enumerate(LABELS)) + ") b(token_bin, ordinal) LEFT JOIN m USING (token_bin) GROUP BY 1, 2")
def bins_in_order(spark, d):
    return _rounded(D.ordered_bins(meta(spark, d)), "share")


for _k in (10, 50):
    query(_META + f"SELECT source || '+' || category || '+' || domain || '+' || language AS subclass, round(sum(token_count) / (SELECT sum(token_count) FROM m), 9) AS share FROM m GROUP BY 1 ORDER BY sum(token_count) DESC, 1 LIMIT {_k}", f"subclass_top{_k}")(
        lambda spark, d, _k=_k: _rounded(D.top_subclasses(meta(spark, d), _k), "share")
    )


@query(_META + "SELECT doc_id, source || '+' || category || '+' || domain || '+' || language AS subclass FROM m")
def subclass_keys(spark, d):
    return meta(spark, d).select("doc_id", subclass_key(*[F.col(c) for c in ("source", "category", "domain", "language")]).alias("subclass"))


@query(_META + "SELECT count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 6) AS mean_tokens, round(sum(token_count) / (SELECT sum(token_count) FROM m), 9) AS ratio FROM m WHERE language = 'en'")
def corpus_summary(spark, d):
    m = meta(spark, d)
    return _rounded(_rounded(D.summary(m.where("language = 'en'"), m), "mean_tokens", digits=6), "ratio")


@query("SELECT count(DISTINCT text) AS unique_ids, round(count(DISTINCT text) / count(*), 9) AS share FROM documents")
def unique_texts(spark, d):
    return _rounded(D.unique_ids(table(spark, d, "documents"), "text"), "share")


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def distinct_languages(spark, d):
    return D.distinct_values(table(spark, d, "documents"), "lang")


@query("SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes, CAST(ceil(sum(strlen(text) + 1) / 100000) AS BIGINT) AS shards FROM documents")
def shard_estimate(spark, d):
    return D.shard_estimate(table(spark, d, "documents"), 100_000)


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def per_source_progress(spark, d):
    return D.per_file(table(spark, d, "documents").withColumnRenamed("n_chars", "token_count"), "source")


# --- mixing -----------------------------------------------------------------------------------------------------------

TARGETS = {"language": {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}, "category": {"q1": 0.5, "q0": 0.05, "unlabeled": 0.45}}
PRIORITY = ("category", "language")
TOTAL = 500_000.0


def _targets_sql() -> str:
    return "t(dim, value, ratio) AS (VALUES " + ", ".join(f"('{a}', '{v}', CAST({x} AS DOUBLE))" for a, own in TARGETS.items() for v, x in own.items()) + ")"


@query(_META + ", " + _targets_sql() + f", s AS ({_ALL}) SELECT t.dim, t.value, t.ratio, s.share AS present, s.share IS NOT NULL AS exists_, coalesce(t.ratio > 1.05 * s.share, false) AS over FROM t LEFT JOIN s USING (dim, value)")
def ratio_feasibility(spark, d):
    spec = spark.createDataFrame([(a, v, x) for a, own in TARGETS.items() for v, x in own.items()], "dim string, value string, ratio double")
    have = _rounded(D.distributions(meta(spark, d)), "share")
    both = F.broadcast(spec).join(have, ["dim", "value"], "left")
    return both.select("dim", "value", "ratio", F.col("share").alias("present"), F.col("share").isNotNull().alias("exists_"), F.coalesce(F.col("ratio") > 1.05 * F.col("share"), F.lit(False)).alias("over"))


@query(_META + "SELECT language, category, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS n FROM m GROUP BY 1, 2")
def mixing_cells(spark, d):
    return mixing.cells(meta(spark, d), ["language", "category"])


def _case(dim: str) -> str:
    return f"CASE {dim} " + " ".join(f"WHEN '{v}' THEN CAST({x} AS DOUBLE)" for v, x in TARGETS[dim].items()) + " END"


def _sweep_sql() -> str:
    sql = f", c0 AS (SELECT language, category, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS n FROM m GROUP BY 1, 2), w0 AS (SELECT *, {TOTAL} / sum(tokens) OVER () AS weight FROM c0), b0 AS (SELECT *, sum(weight * tokens) OVER () AS base FROM w0)"
    last = "b0"
    for k, dim in enumerate(PRIORITY, 1):
        sql += f", r{k} AS (SELECT *, sum(weight * tokens) OVER (PARTITION BY {dim}) / base AS r{k}_, {_case(dim)} AS x{k}_ FROM {last})"
        sql += f", b{k} AS (SELECT language, category, tokens, n, base, weight * CASE WHEN r{k}_ > 1e-5 AND x{k}_ > 0 THEN least(greatest(x{k}_ / r{k}_, 0.7), 1.4) * least(greatest({TOTAL} / base, 0.8), 1.2) ELSE 1 END AS weight FROM r{k})"
        last = f"b{k}"
    return sql + f" SELECT language, category, tokens, n, round(weight, 9) AS weight FROM {last}"


@query(_META + _sweep_sql())
def ipf_sweep_1(spark, d):
    return _rounded(mixing.sweep(mixing.cells(meta(spark, d), ["language", "category"]), TARGETS, TOTAL, PRIORITY), "weight")


def _fit(variant: str, dims: tuple[str, ...] = PRIORITY) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = mixing.fit(meta(spark, d), {k: TARGETS[k] for k in dims}, TOTAL, dims, variant)
        return spark.createDataFrame([(*[c[k] for k in dims], int(c["tokens"]), int(c["n"]), rounded_number(float(w)), f.ok) for c, w in zip(f.cells, f.weights)], ", ".join(f"{k} string" for k in dims) + ", tokens bigint, n bigint, weight double, ok boolean")

    return run


def _ipf_sql(variant: str, dims: tuple[str, ...] = PRIORITY, sweeps: int = 8) -> str:
    """CTEs that unroll some sweeps of mixing.solve(); the last, ipf, has the weights. A
    sweep behind the stop changes nothing, so it may be any number that reaches the stop."""
    plain, stale, together = variant == "plain", variant == "priority", variant in ("accumulated", "chunked")
    tol, still = (0.01 if plain or variant == "chunked" else 0.005), (1e-4 if plain else 1e-5)
    cell, mets, lasts = ", ".join(dims), ", ".join(f"met_{x}" for x in dims), ", ".join(f"last_{x}" for x in dims)
    keep = f"{cell}, tokens, n, before, whole, done, {mets}, {lasts}"
    init = f"{TOTAL} / sum(tokens) OVER ()" if stale else "CAST(1 AS DOUBLE)"
    ctes = [f"c0 AS MATERIALIZED (SELECT {cell}, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS n FROM m WHERE {' AND '.join(f'{x} IS NOT NULL' for x in dims)} GROUP BY ALL)"]
    ctes.append(f"x0 AS MATERIALIZED (SELECT *, {init} AS w, false AS done, {', '.join(f'false AS met_{x}, CAST(0 AS DOUBLE) AS last_{x}' for x in dims)} FROM c0)")
    for k in range(1, sweeps + 1):
        last = f"b{k}"
        ctes.append(f"{last} AS MATERIALIZED (SELECT * EXCLUDE (w), w, w AS before, sum(w * tokens) OVER () AS whole, CAST(0 AS DOUBLE) AS worst FROM x{k - 1})")
        for dim in dims:
            for j, (v, x) in enumerate(TARGETS[dim].items()):
                now, base = f"u{k}_{dim}_{j}", "whole" if stale else "sum(w * tokens) OVER ()"
                limits = f"{x} / share" if plain else f"least(greatest({x} / share, 0.7), 1.4) * least(greatest({TOTAL} / whole, 0.8), 1.2)" if stale else f"least(greatest({x} / (share + {1e-8 if together else 0}), 0.5), 2.0)"
                skip = "done" + (f" OR met_{dim}" if variant == "frozen" else "") + ("" if plain or x > 0 else " OR true")
                ctes.append(f"s{now} AS MATERIALIZED (SELECT *, sum(CASE WHEN {dim} = '{v}' THEN w * tokens ELSE 0 END) OVER () / {base} AS share FROM {last})")
                ctes.append(f"{now} AS MATERIALIZED (SELECT {keep}, {'greatest(worst, ' if j else '('}abs(share - {x})) AS worst, CASE WHEN {dim} = '{v}' AND share > 1e-5 AND NOT ({skip}) THEN w * {limits} ELSE w END AS w FROM s{now})")
                last = now
            out = f"e{k}_{dim}"
            worst = f"CASE WHEN met_{dim} THEN 0 ELSE worst END" if variant == "frozen" else "worst"
            ctes.append(f"{out} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN done THEN last_{dim} ELSE {worst} END AS last_{dim}, met_{dim} OR (NOT done AND worst < {tol}) AS met_{dim}) FROM {last})")
            last = out
        close = " AND ".join(f"met_{x}" if together else f"last_{x} < {tol}" for x in dims)
        stop = "" if variant == "chunked" else f" OR sum(n * abs(w - before) / (before + 1e-5)) OVER () / sum(n) OVER () < {still}"
        ctes.append(f"x{k} AS MATERIALIZED (SELECT {cell}, tokens, n, w, done OR ({close}){stop} AS done, {mets}, {lasts} FROM {last})")
    ctes.append(f"scaled AS MATERIALIZED (SELECT {cell}, tokens, n, {lasts}, w * {TOTAL} / sum(w * tokens) OVER () AS weight FROM x{sweeps})")
    errors = ", ".join(f"abs(sum(weight * tokens) FILTER ({dim} = '{v}') / sum(weight * tokens) - {x})" for dim in dims for v, x in TARGETS[dim].items())
    ok = " AND ".join(f"last_{x} < {tol}" for x in dims) if plain else f"(SELECT greatest({errors}) FROM scaled) <= {tol}"
    ctes.append(f"ipf AS MATERIALIZED (SELECT {cell}, tokens, n, weight, {ok} AS ok FROM scaled)")
    return ", " + ", ".join(ctes)


for _v in ("plain", "frozen", "accumulated", "chunked", "priority"):
    query(_META + _ipf_sql(_v) + " SELECT language, category, tokens, n, round(weight, 9) AS weight, ok FROM ipf", f"ipf_{_v}")(_fit(_v))


query(_META + _ipf_sql("priority", ("language",)) + " SELECT language, tokens, n, round(weight, 9) AS weight, ok FROM ipf", "ipf_one_dimension")(_fit("priority", ("language",)))


def uniform_sql(key: str, seed: int = 0) -> str:
    """functions.text.uniform in SQL."""
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query(
    _META + _ipf_sql("priority") + f", x AS (SELECT m.*, coalesce(weight, 0) AS weight, {uniform_sql('doc_id')} AS u, {uniform_sql('doc_id', 1)} AS u1 FROM m LEFT JOIN ipf USING (language, category)), "
    "y AS (SELECT *, u < least(weight, 1) AS taken FROM x), z AS (SELECT coalesce(sum(token_count) FILTER (taken), 0) AS got, sum(token_count) FILTER (NOT taken) AS rest FROM y) "
    f"SELECT doc_id, source, category, domain, language, token_count, token_bin FROM y, z WHERE taken OR (got < 0.95 * {TOTAL} AND u1 < least(({TOTAL} - got) / rest, 1) AND token_count > 0)"
)
def mix_sample(spark, d):
    own = D.with_bin(meta(spark, d))
    f = mixing.fit(own, TARGETS, TOTAL, PRIORITY)
    return mixing.sample(mixing.weighted(own, f, list(TARGETS)), TOTAL, "doc_id").select("doc_id", "source", "category", "domain", "language", "token_count", "token_bin")


_WEIGHTS = {"language": {"en": 0.5, "de": 2.0, "fr": 0.75}, "category": {"q0": 0.1, "q1": 1.3}}


@query(_META + "SELECT doc_id, round(greatest(0, least(1, CAST(1 AS DOUBLE) " + " ".join(f"* CASE {a} " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in own.items()) + " ELSE 1 END" for a, own in _WEIGHTS.items()) + ")), 9) AS probability FROM m")
def row_probability(spark, d):
    return _rounded(mixing.row_probability(meta(spark, d), _WEIGHTS).select("doc_id", "probability"), "probability")


@query(_META + f", s AS ({_ALL}), k AS (SELECT * FROM m WHERE doc_id % 3 = 0), s2 AS ({_ALL.replace('FROM m ', 'FROM k ')}) SELECT dim, round(max(abs(s.share - coalesce(s2.share, 0))), 8) AS max_deviation FROM s LEFT JOIN s2 USING (dim, value) GROUP BY 1")
def dist_deviation(spark, d):
    m = meta(spark, d)
    return _rounded(D.deviation(m, m.where("doc_id % 3 = 0"), D.DIMENSIONS), "max_deviation", digits=8)


# --- packing ----------------------------------------------------------------------------------------------------------

_CAP = 100_000


@query(
    f"WITH RECURSIVE o AS (SELECT doc_id, strlen(text) + 1 AS b, row_number() OVER (ORDER BY doc_id) AS k FROM documents), "
    f"p AS (SELECT k, doc_id, b, CAST(b AS BIGINT) AS held, CAST(1 AS BIGINT) AS shard FROM o WHERE k = 1 UNION ALL "
    f"SELECT o.k, o.doc_id, o.b, CASE WHEN p.held + o.b > {_CAP} THEN o.b ELSE p.held + o.b END, p.shard + CASE WHEN p.held + o.b > {_CAP} THEN 1 ELSE 0 END FROM p JOIN o ON o.k = p.k + 1) "
    "SELECT doc_id, CAST(b AS BIGINT) AS bytes, shard FROM p"
)
def shard_assign(spark, d):
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.text_bytes(), _CAP, exact=True)


@query(None)
def shard_assign_parallel(spark, d):
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.text_bytes(), _CAP)


# --- predicates, joins, cursors ---------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return conversations.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thatnd')")
def search_text(spark, d):
    return conversations.search(table(spark, d, "documents"), "  THATnd ", id_col="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def soft_delete(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return conversations.search(table(spark, d, "documents"), "the", deleted=gone, id_col="doc_id").select("doc_id")


@query("SELECT item_id, row_number() OVER w AS position, coalesce(lead(item_id) OVER w, min(item_id) OVER ()) AS next_id, coalesce(lag(item_id) OVER w, max(item_id) OVER ()) AS previous_id FROM benchmark WINDOW w AS (ORDER BY item_id)")
def next_previous(spark, d):
    return conversations.neighbours(table(spark, d, "benchmark").select("item_id"), "item_id")


@query("SELECT item_id, row_number() OVER w AS position, lead(item_id) OVER w AS next_id, lag(item_id) OVER w AS previous_id FROM benchmark WINDOW w AS (ORDER BY item_id)")
def next_previous_bounded(spark, d):
    return conversations.bounded_neighbours(table(spark, d, "benchmark").select("item_id"), "item_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, 'c' AS category, 'd' AS domain, lang AS language, CAST(n_chars AS BIGINT) AS token_count FROM documents WHERE doc_id % 5 <> 0")
def jsonl_validate(spark, d):
    """Lines made of documents, every fifth one broken: unparsable, without a field, with a null, or no number."""
    docs = table(spark, d, "documents")
    bad = F.when(F.col("doc_id") % 20 == 0, "abc").when(F.col("doc_id") % 20 == 5, "Infinity").otherwise(F.concat("n_chars", F.lit(".7")))
    inner = F.struct("source", F.lit("c").alias("category"), F.when(F.col("doc_id") % 20 != 10, "d").alias("domain"), F.col("lang").alias("language"), bad.alias("token_count"))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", inner.alias("metadata")), {"ignoreNullFields": "false"})
    lines = docs.select(F.when(F.col("doc_id") % 20 == 15, F.substring(line, 1, 20)).otherwise(line).alias("value"), F.lit("f").alias("file_path"))
    return readers.typed(lines, nested=True, with_text=False).select("id", "source", "category", "domain", "language", "token_count")


@query("SELECT doc_id AS id, md5(text || chr(10)) AS line_hash FROM documents")
def line_hashes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.line_hash(F.col("text")).alias("line_hash"))


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality > 0")
def score_threshold(spark, d):
    return conversations.above_score(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "quality", 0).select("doc_id", "quality")


# --- text functions ---------------------------------------------------------------------------------------------------


def on_documents(name: str, sql: str, make: Callable[[Column], Column], before: str = "text") -> None:
    """A query that applies an expression to (text as prepared by `before`)."""
    query(f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, {before} AS text FROM documents)", name)(
        lambda spark, d: table(spark, d, "documents").select("doc_id", F.expr(before).alias("text")).select("doc_id", make(F.col("text")).alias("out"))
    )


on_documents("remove_whitespace", r"regexp_replace(text, '\s+', '', 'g')", lambda t: T.remove_whitespace(t))
on_documents("remove_images", r"regexp_replace(text, '!\[[^\]]*\] ?(?:\([^)]*\)|\[[^\]]*\])', '', 'g')", lambda t: T.remove_images(t), "'![fig](a.png) ' || text || ' ![e] [ref] end'")
on_documents(
    "remove_formulas",
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\\begin\{[^}]*\}.*?\\end\{[^}]*\}', '', 'g'), '(?s)\$\$.*?\$\$', '', 'g'), '(?s)\\\[.*?\\\]', '', 'g'), '(?s)\\\(.*?\\\)', '', 'g'), '(?s)\$.*?\$', '', 'g')",
    lambda t: T.remove_formulas(t),
    "'a $x+y$ b $$z$$ ' || text",
)
on_documents("cjk_language", "CASE WHEN len(regexp_extract_all(text, '[一-鿿]+')) / greatest(1, length(text)) > 0.3 THEN 'zh' ELSE 'en' END", lambda t: T.cjk_language(t), "CASE WHEN doc_id % 2 = 0 THEN '中a文b字c' ELSE text END")
on_documents("strip_tags", "regexp_replace(coalesce(text, ''), '<.*?>', '', 'g')", lambda t: T.strip_tags(t), "'<b>' || text || '</b>'")
on_documents("safe_filename", r"""coalesce(nullif(trim(substr(regexp_replace(text, '[\\/*?:"<>|]', '', 'g'), 1, 50), chr(32) || chr(9) || chr(10) || chr(13)), ''), 'conversation')""", lambda t: T.safe_filename(t), "CASE WHEN doc_id % 7 = 0 THEN '??' ELSE text END")
on_documents("question_lines", "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), chr(31))", lambda t: F.array_join(T.question_lines(t), "\x1f"))
on_documents("question_count", "CAST(greatest(1, floor(length(text) / 4096)) AS INTEGER)", lambda t: T.question_count(F.length(t)))
on_documents("clean_email", r"regexp_replace(text, '[A-Za-z0-9.\-+_]+@[A-Za-z0-9.\-+_]+\.[A-Za-z]+', '', 'g')", lambda t: R.clean_email(t))
on_documents(
    "clean_links",
    r"""regexp_replace(text, '(?i)\b(?:https?|ftp)://[^\s<>"'']+|\bwww\.[^\s<>"'']+', '', 'g')""",
    lambda t: R.clean_links(t),
    "text || ' see https://a.example/x?y=1 and www.b.example end'",
)
on_documents("normalise_punctuation", "translate(text, '，。：；！？（）', ',.:;!?()')", lambda t: R.normalise_punctuation(t), "text || '，。：；！？（）'")
on_documents("normalise_whitespace", "trim(translate(text, chr(8201) || chr(12288), '  '), ' ')", lambda t: R.normalise_whitespace(t), "'　' || text || ' x '")
on_documents("think_split", "CASE WHEN doc_id % 3 = 0 THEN 'reason' || '|' || 'reply ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'reason' || '|' || 'reply' ELSE '|plain' END", lambda t: F.concat(T.think_answer(t).think, F.lit("|"), T.think_answer(t).answer), "CASE WHEN doc_id % 3 = 0 THEN 'lost <think> reason </think> reply ' || CAST(doc_id AS STRING) WHEN doc_id % 3 = 1 THEN 'reason</think>reply</think>' ELSE '<think>plain' END")
ORACLES["think_split"] = ORACLES["think_split"].replace("(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lost <think> reason </think> reply ' || CAST(doc_id AS STRING) WHEN doc_id % 3 = 1 THEN 'reason</think>reply</think>' ELSE '<think>plain' END AS text FROM documents)", "documents")
ORACLES["normalise_whitespace"] = "SELECT doc_id, trim(text || ' x', ' ') AS out FROM documents"

_STATS = {
    "alphanumeric_filter": r"len(regexp_extract_all(text, '[\p{L}\p{N}]')) / length(text)",
    "average_line_length_filter": "length(text) / len(string_split(text, chr(10)))",
    "maximum_line_length_filter": "list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))",
    "special_characters_filter": r"len(regexp_extract_all(text, '[^\p{L}\p{N} ]')) / length(text)",
    "text_length_filter": "length(text)",
    "words_num_filter": r"len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))",
}
for _n, _s in _STATS.items():
    on_documents(f"stat_{_n}", f"round(CAST({_s} AS DOUBLE), 9)", lambda t, _n=_n: rounded(FILTERS[_n][0](t, FILTERS[_n][1]).cast("double")))
    _bounds = " AND ".join(f"({_s}) {'>=' if k.startswith('min') else '<='} {v}" for k, v in FILTERS[_n][1].items())
    query(f"SELECT doc_id FROM documents WHERE {_bounds}", _n)(lambda spark, d, _n=_n: table(spark, d, "documents").where(condition(_n, F.col("text"))).select("doc_id"))


@query(
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents), "
    "g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 8, 1)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS gram FROM w), "
    "c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS s FROM c GROUP BY 1) "
    "SELECT doc_id, round(coalesce(s, 0), 9) AS out FROM documents LEFT JOIN r USING (doc_id)"
)
def stat_word_repetition_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(R.word_repetition(F.col("text"))).alias("out"))


@query(r"SELECT doc_id, round(len(list_filter(ws, lambda w: w IN ('idiot', 'moron', 'scum'))) / greatest(len(ws), 1), 9) AS out FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents)")
def stat_flagged_words_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", rounded(R.flagged_share(F.col("text"), ("idiot", "moron", "scum"))).alias("out"))


@query(None)
def simhash_pairs(spark, d):
    return simhash.pairs(table(spark, d, "documents"))


@query(None)
def simhash_dedup(spark, d):
    return simhash.deduplicate(table(spark, d, "documents")).select("doc_id")


@query("SELECT doc_id, '| a | ' || CAST(doc_id AS VARCHAR) || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| b |   |' AS out FROM documents")
def table_to_markdown(spark, d):
    html = F.concat(F.lit("<table><tr><td>a</td><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr><tr><td colspan=2>b</td></tr></table>"))
    return table(spark, d, "documents").select("doc_id", tables_to_markdown(html).alias("out"))


@query(None)
def cleaned_documents(spark, d):
    return cleaning.clean(table(spark, d, "documents"), id_col="doc_id")[0]


# --- conversations ----------------------------------------------------------------------------------------------------

_LIST = "WITH g AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS messages FROM conversations GROUP BY 1) "


def _gathered(spark, d):
    return conversations.gather(table(spark, d, "conversations"))


def _with_think(spark, d):
    """The conversations, an assistant's text as a think part of 5 characters and an answer."""
    a, none = lambda x: x.role == "assistant", F.lit(None).cast("string")
    m = lambda x: F.struct(x.role.alias("role"), F.when(~a(x), x.content).alias("content"), F.when(a(x), F.substring(x.content, 1, 5)).otherwise(none).alias("think"), F.when(a(x), F.substring(x.content, F.lit(6), F.length(x.content))).alias("answer"))
    return _gathered(spark, d).withColumn("messages", F.transform("messages", m))


@query(_LIST + "SELECT conv_id, array_to_string(list_transform(messages, lambda m: (CASE WHEN m.role = 'user' THEN 'Q: ' ELSE 'A: ' END) || m.content), chr(10)) AS out FROM g")
def history_text(spark, d):
    return _gathered(spark, d).select("conv_id", conversations.history(F.col("messages")).alias("out"))


@query(_LIST + "SELECT conv_id, messages[1].role AS first_role, len(messages) AS n, list_filter(messages, lambda m: m.role = 'user')[1].content AS query FROM g")
def first_queries(spark, d):
    m = F.col("messages")
    return _gathered(spark, d).select("conv_id", F.get(m, F.lit(0)).role.alias("first_role"), F.size(m).cast("bigint").alias("n"), conversations.first_query(m).alias("query"))


@query("WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, u.text AS question, a.text AS answer FROM u JOIN a USING (conv_id, i)")
def turn_pairs(spark, d):
    return _gathered(spark, d).select("conv_id", F.posexplode(conversations.pair_turns(F.col("messages"))).alias("pos", "p")).select("conv_id", "pos", "p.question", "p.answer")


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations")
def parent_chain(spark, d):
    return conversations.parent_chain(table(spark, d, "conversations")).select("conv_id", "turn", "parent")


@query("SELECT conv_id, turn, CAST(1 + coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS round FROM conversations")
def turn_rounds(spark, d):
    return conversations.number_rounds(table(spark, d, "conversations")).select("conv_id", "turn", F.col("round").cast("bigint").alias("round"))


@query(
    "WITH f AS (SELECT conv_id, arg_min(substr(text, 1, 1), turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1), "
    "t AS (SELECT query, conv_id, turn, text FROM f JOIN conversations USING (conv_id) WHERE text <> ''), "
    "x AS (SELECT query, text, min((conv_id, turn)) AS o FROM t GROUP BY 1, 2) "
    "SELECT query, min(o[1]) AS first, (SELECT count(*) FROM f WHERE f.query = x.query) AS n_records, array_to_string(list(text ORDER BY o), chr(31)) AS contents FROM x GROUP BY 1".replace("o[1]", "struct_extract_at(o, 1)")
)
def label_merge(spark, d):
    own = _gathered(spark, d)
    key = F.substring(conversations.first_query(F.col("messages")), 1, 1)
    return conversations.merge_by_first_query(own, key, "conv_id").withColumn("contents", F.array_join("contents", "\x1f"))


@query(_LIST + "SELECT conv_id FROM g WHERE len(list_filter(messages, lambda m: m.role = 'user')) > 0")
def with_user_turn(spark, d):
    return conversations.without_user_turn(_gathered(spark, d)).select("conv_id")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos, role, CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || substr(text, 1, 5) || chr(10) || '</think>' || chr(10) || chr(10) || substr(text, 6) ELSE text END AS content FROM conversations")
def sharegpt_convert(spark, d):
    own = conversations.to_sharegpt(_with_think(spark, d))
    return own.select("conv_id", F.posexplode("messages").alias("pos", "m")).select("conv_id", "pos", "m.role", "m.content")


@query(
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations), "
    "p AS (SELECT a.conv_id, a.i // 2 + 1 AS k, a.text AS q, b.text AS r FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.role = 'user' AND b.role = 'assistant') "
    "SELECT c.conv_id, coalesce((SELECT string_agg('Question ' || k || ': ' || q || chr(10) || 'Answer ' || k || ':' || chr(10) || 'Reasoning:' || chr(10) || substr(r, 1, 5) || chr(10) || 'Final answer:' || chr(10) || substr(r, 6), chr(10) ORDER BY k) FROM p WHERE p.conv_id = c.conv_id), '') AS out FROM (SELECT DISTINCT conv_id FROM conversations) c"
)
def qa_text(spark, d):
    return _with_think(spark, d).select("conv_id", conversations.as_text(F.col("messages")).alias("out"))


@query("SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1 OR doc_id % 11 = 0")
def verdict_filter(spark, d):
    """Replies made of labels, every eleventh one without an object: those don't reject."""
    reply = F.when(F.col("doc_id") % 11 == 0, "no object").otherwise(F.concat(F.lit('```json\n{"is_filter": '), F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit(', "reason": "r",}\n```')))
    return conversations.accepted(table(spark, d, "labels").withColumn("v", model_calls.verdict(reply)), ["v"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 10 ELSE CAST(quality * 7 AS DOUBLE) END AS score FROM labels WHERE doc_id % 11 = 0 OR quality * 7 > 5")
def score_verdicts(spark, d):
    reply = F.when(F.col("doc_id") % 11 == 0, "none").otherwise(F.concat(F.lit('{"score": '), (F.col("quality") * 7).cast("string"), F.lit("}")))
    own = table(spark, d, "labels").select("doc_id", model_calls.score(reply, 10).score.alias("score"))
    return conversations.above_score(own)


@query("SELECT item_id FROM benchmark WHERE item_id % 3 = 0")
def judge_answers(spark, d):
    reply = F.when(F.col("item_id") % 3 == 0, " yes ").when(F.col("item_id") % 3 == 1, "NO").otherwise("YES, because")
    return table(spark, d, "benchmark").where(model_calls.yes(reply)).select("item_id")


on_documents("fill_template", "'Read: ' || text || ' (' || text || ') {n}'", lambda t: T.fill_template("Read: {text} ({text}) {n}", {"text": t}))
on_documents("approximate_tokens", r"CAST(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[^\s一-鿿]+')) AS INTEGER)", lambda t: T.approximate_tokens(t), "'中文' || text")
on_documents("trim_paper", "'# T' || chr(10) || text || chr(10)", lambda t: trimmed_paper(F.concat(F.lit("front\n# T\n"), t, F.lit("\n## References\nx"))).body)
on_documents("think_headings", "'## Reasoning' || chr(10) || 'r' || chr(10) || chr(10) || '## Answer' || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(13))", lambda t: T.think_headings(F.concat(F.lit("<think>r</think>"), t)))


@query(None)
def token_chunks(spark, d):
    return cleaning.chunks(table(spark, d, "documents").withColumn("file_path", F.col("doc_id").cast("string")), least=50, most=400)


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy("event_type", F.window("ts", "1 hour").start.alias("hour")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["dist_source"](spark, "/root/testdata/sf0.001")


from grainmill import file_queries  # noqa: E402, F401  registers its queries
