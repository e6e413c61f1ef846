"""Text functions as column expressions (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space in Java's syntax.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
FORMULA_PATTERNS = (
    r"(?s)\\begin\{[^}]*\}.*?\\end\{[^}]*\}",
    r"(?s)\$\$.*?\$\$",
    r"(?s)\\\[.*?\\\]",
    r"(?s)\\\(.*?\\\)",
    r"(?s)\$.*?\$",
)
IMAGE_PATTERN = r"!\[[^\]]*\] ?(?:\([^)]*\)|\[[^\]]*\])"


def let(value: Column, body) -> Column:
    """body(value) with value computed once. Higher-order functions would compute
    what their lambda refers to anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lit(s: str) -> Column:
    return F.lit(s.replace("\\", "\\\\").replace("$", "\\$"))


def remove_whitespace(t: Column) -> Column:
    return F.regexp_replace(t, _WS + "+", "")


def trim_all(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{_WS}+|{_WS}+$", "")


def remove_images(t: Column) -> Column:
    """Drops markdown images, inline or by reference."""
    return F.regexp_replace(t, IMAGE_PATTERN, "")


def remove_formulas(t: Column, by: str = "") -> Column:
    """Replaces LaTeX: environments, display, bracket, parenthesis and inline
    dollar forms, one after the other ("$5 and $6" is taken for one)."""
    for p in FORMULA_PATTERNS:
        t = F.regexp_replace(t, F.lit(p), _lit(by))
    return t


def cjk_language(t: Column, by_characters: bool = False) -> Column:
    """zh where runs of CJK characters (or the characters, if by_characters)
    are over 0.3 of the length; else en."""
    n = F.regexp_count(t, F.lit("[一-鿿]" + ("" if by_characters else "+")))
    return F.when(n / F.greatest(F.lit(1), F.length(t)) > 0.3, "zh").otherwise("en")


def strip_tags(t: Column) -> Column:
    """Drops <...> within a line; null becomes empty."""
    return F.regexp_replace(F.coalesce(t, F.lit("")), "<.*?>", "")


def think_answer(t: Column) -> Column:
    """struct<think, answer> of a reply. With both tags: the first block, and what
    follows it, trimmed; what stands before it is dropped. With the closing tag
    alone: what stands before, and the rest without further closing tags.
    Without: an empty think, and the text without a stray opening tag."""
    block = r"(?s)<think>(.*?)</think>(.*)"
    both = F.regexp_like(t, F.lit(block))
    at = F.instr(t, "</think>")
    tail = F.replace(F.substring(t, at + F.lit(8), F.length(t)), F.lit("</think>"), F.lit(""))
    return (
        F.when(both, F.struct(trim_all(F.regexp_extract(t, block, 1)).alias("think"), trim_all(F.regexp_extract(t, block, 2)).alias("answer")))
        .when(at > 0, F.struct(trim_all(F.substring(t, F.lit(1), at - 1)).alias("think"), trim_all(tail).alias("answer")))
        .when(t.isNotNull(), F.struct(F.lit("").alias("think"), trim_all(F.replace(t, F.lit("<think>"), F.lit(""))).alias("answer")))
    )


def think_headings(t: Column, think: str = "## Reasoning", answer: str = "## Answer") -> Column:
    """A reply with a think block as two headed sections; else unchanged."""
    block = r"(?s)<think>(.*?)</think>(.*)"
    made = F.concat(F.lit(think + "\n"), trim_all(F.regexp_extract(t, block, 1)), F.lit(f"\n\n{answer}\n"), trim_all(F.regexp_extract(t, block, 2)))
    return F.when(F.regexp_like(t, F.lit(block)), made).otherwise(t)


def inline_think(think: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), F.coalesce(think, F.lit("")), F.lit("\n</think>\n\n"), F.coalesce(answer, F.lit("")))


def safe_filename(t: Column, default: str = "conversation") -> Column:
    """At most 50 characters, without those that file systems forbid."""
    cut = trim_all(F.substring(F.regexp_replace(t, r'[\\/*?:"<>|]', ""), 1, 50))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def question_lines(t: Column) -> Column:
    """The trimmed lines of a text that aren't empty."""
    return F.filter(F.transform(F.split(t, "\n"), trim_all), lambda x: x != "")


def question_count(tokens: Column, per: int = 4096) -> Column:
    return F.greatest(F.lit(1), F.floor(tokens / F.lit(per))).cast("int")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Puts values into {name} marks, each found once in the template itself:
    what a value says is never substituted again."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)], F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def line_hash(line: Column) -> Column:
    """md5 of a line with its end."""
    return F.md5(F.concat(line, F.lit("\n")))


def contains_query(t: Column, query: str) -> Column:
    """Case-insensitive containment of the trimmed query; null never matches."""
    return F.coalesce(F.contains(F.lower(t), F.lower(F.lit(query.strip()))), F.lit(False))


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and seed alone (the first 52 bits of
    their md5): a task that runs again draws the same, and so does any other engine."""
    digits = F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def rounds(key: Column, most: int = 6, seed: int = 0) -> Column:
    """Follow-up rounds: 0 with probability 0.8, else 1..6 alike, at most `most`; by the key."""
    u = uniform(key, seed)
    return F.least(F.when(u < 0.8, 0).otherwise(F.least(F.floor((u - 0.8) / (0.2 / 6)) + 1, F.lit(6))), F.lit(most)).cast("int")


def approximate_tokens(t: Column) -> Column:
    """CJK characters and other words: a count without a tokenizer; null is 0."""
    t = F.coalesce(t, F.lit(""))
    return (F.regexp_count(t, F.lit("[一-鿿]")) + F.regexp_count(t, F.lit(r"[^\s一-鿿]+"))).cast("int")


def object_in(text: Column) -> Column:
    """The first {...} of a model's reply, as JSON text: code fences, comments around
    it, single quotes and trailing commas are mended where the strict form fails."""
    raw = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    mended = F.regexp_replace(F.regexp_replace(raw, r",\s*([}\]])", "$1"), r"(?<=[{,\[:\s])'([^'\"]*)'(?=\s*[:,}\]])", '"$1"')
    ok = F.try_parse_json(raw).isNotNull()
    return F.when(ok, raw).otherwise(F.when(F.try_parse_json(mended).isNotNull(), mended))
