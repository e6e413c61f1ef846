"""Document cleaning: images and tables, chunks, formulas, language and quality gates.

Chunks are exploded, judged as columns and put together again by document; what
was rejected is a table of its own. Detectors are functions of a column."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import markdown, text

#: text -> struct<label: string, score: double>
Detector = Callable[[Column], Column]
#: (text, label) -> struct<ok: boolean, flag: string>
Gate = Callable[[Column, Column], Column]


def script_language(t: Column) -> Column:
    """Default detector: zh by its characters, else en, with the share that speaks for it."""
    cjk = F.regexp_count(t, F.lit("[一-鿿]"))
    letters = F.greatest(F.regexp_count(t, F.lit(r"\p{L}")), F.lit(1))  # counted where it matters
    of = lambda share: F.struct(F.when(share > 0.3, "zh").otherwise("en").alias("label"), F.when(share > 0.3, F.least(F.lit(1.0), share + 0.5)).otherwise(1 - share).alias("score"))
    return text.let(F.when(cjk > 0, cjk / letters).when(cjk == 0, F.lit(0.0)), of)


def length_gate(t: Column, label: Column, least: int = 20) -> Column:
    """Default gate: too short texts have the flag that keeps them, symbol soup goes."""
    n = F.length(t)
    odd = F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(n, F.lit(1))
    flag = F.when(n < least, "total character count too small").when(odd > 0.35, "special characters")
    return F.struct(flag.isNull().alias("ok"), flag.alias("flag"))


def label_of(t: Column, detect: Detector = script_language) -> Column:
    """CN or EN, by the detector; an empty text is CN."""
    return F.when(F.coalesce(F.trim(t), F.lit("")) == "", "CN").when(detect(F.replace(t, F.lit("\n"), F.lit(" "))).label == "zh", "CN").otherwise("EN")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: what reads or filters it gets a generator's
    output, where the optimiser would put copies of its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def clean(
    docs: DataFrame, id_col: str = "id", text_col: str = "text", most: int = 2048, detect: Detector = script_language,
    gate: Gate = length_gate, sure: float = 0.8, empty_after_formulas: str = "keep", latex: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned, rejects). Images go, tables become pipe tables, a text is cut at
    headings; a chunk stays if it is zh or en for sure and passes the gate, or
    fails it only for being short. Formulas are left out where a chunk is judged,
    not where it is kept. Rejects are (id, pos, flag, text) of the gate; chunks
    of other languages go without a line there. A chunk that consists of formulas
    stays ("keep") or goes ("drop"). latex, where given, sees the whole cleaned text
and gives struct<text: string, rejected: array<struct<flag: string, text: string>>>;
what it rejects joins the rejects at position -1."""
    body = markdown.tables_to_markdown(text.remove_images(F.col(text_col)))
    # a text without a chunk, such as an image alone, is an empty one
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode_outer(markdown.heading_chunks(body, most)).alias("pos", "chunk"))
    parts = once(parts, "bare", text.remove_formulas(F.col("chunk")))
    parts = once(parts, "lang", detect(F.replace(F.col("bare"), F.lit("\n"), F.lit(" "))))
    parts = once(parts, "verdict", gate(F.col("bare"), F.col("lang.label")))
    blank = F.trim(F.col("bare")) == ""
    known = F.col("lang.label").isin("zh", "en") & (F.col("lang.score") > sure)
    short = F.contains(F.coalesce("verdict.flag", F.lit("")), F.lit("total character count"))
    stays = F.when(blank, F.lit(empty_after_formulas == "keep")).otherwise(known & (F.col("verdict.ok") | short))
    judged = parts.select("id", "pos", "chunk", "verdict.flag", stays.alias("stays"), (~blank & known & ~F.col("verdict.ok") & ~short).alias("rejected"))
    whole = judged.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "chunk")))).alias("kept"))
    cleaned = whole.select("id", F.array_join(F.transform("kept", lambda x: x.chunk), "").alias("text"))
    rejects = judged.where("rejected").select("id", "pos", "flag", F.col("chunk").alias("text"))
    if latex is None:
        return cleaned, rejects
    seen = cleaned.select("id", latex(F.col("text")).alias("l"))
    bad = seen.select("id", F.explode("l.rejected").alias("r")).select("id", F.lit(-1).alias("pos"), "r.flag", "r.text")
    return seen.select("id", "l.text"), rejects.union(bad)


def chunks(docs: DataFrame, text_col: str = "text", path_col: str = "file_path", least: int = 2000, most: int = 15_000, count: Callable[[str], int] = markdown.word_count, detect: Detector = script_language) -> DataFrame:
    """(id, text, text_length, language, file_path): token-bounded chunks of at least
    `least` tokens; the id is a digest of path and place, the same in each run."""
    parts = docs.select(F.col(path_col).alias("file_path"), F.posexplode(markdown.counted_chunks(F.col(text_col), most, count)).alias("pos", "c"))
    sized = parts.select("file_path", "pos", "c.text", F.col("c.n").alias("text_length")).where(F.col("text_length") >= least)
    ident = F.substring(F.sha2(F.concat_ws("|", "file_path", F.col("pos").cast("string"), F.md5("text")), 256), 1, 32)
    return sized.select(ident.alias("id"), "text", "text_length", label_of(F.col("text"), detect).alias("language"), "file_path")


class _Late(BaseException):
    pass


def guarded(docs: DataFrame, f: Callable[[str], str], text_col: str = "text", seconds: float = 300, out: str | None = None) -> DataFrame:
    """docs with f of the text, and `status`: ok, null (a null text), timeout or error
    with what was raised. A text for which f takes over `seconds` or fails is passed
    through unchanged, so one bad document costs neither its task nor itself."""

    def late(*_):
        raise _Late

    def one(t: str | None) -> tuple[str | None, str]:
        if t is None:
            return None, "null"
        try:
            if seconds and threading.current_thread() is threading.main_thread():
                signal.setitimer(signal.ITIMER_REAL, seconds)
            return f(t), "ok"
        except _Late:
            return t, "timeout"
        except Exception as e:
            return t, f"error: {type(e).__name__}: {e}"
        finally:
            if seconds and threading.current_thread() is threading.main_thread():
                signal.setitimer(signal.ITIMER_REAL, 0)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        main = threading.current_thread() is threading.main_thread()
        before = signal.signal(signal.SIGALRM, late) if main else None
        try:
            for x in batches:
                made = [one(t) for t in x.to_pylist()]
                yield pa.array([{"text": t, "status": s} for t, s in made], pa.struct([("text", pa.string()), ("status", pa.string())]))
        finally:
            if main:
                signal.signal(signal.SIGALRM, before)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = docs.withColumn("__g", F.arrow_udf(run, "struct<text: string, status: string>")(F.col(text_col)))
    return made.withColumns({out or text_col: F.col("__g.text"), "status": F.col("__g.status")}).drop("__g")
