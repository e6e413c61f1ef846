"""Markdown functions that need a parser: plain Python over one text, and Arrow
UDFs over them. Each UDF is only applied where a cheap test says it's needed."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s", re.M)
_TABLE = re.compile(r"(?:<html>\s*<body>\s*)?<table\b.*?</table>(?:\s*</body>\s*</html>)?", re.I | re.S)
_FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$]+?\$", re.S)


def trim_paper(text: str) -> tuple[str, str, str]:
    """(body, before the first heading, references section). Without a heading all
    of it is front matter. Of the last three headings the last that says
    references ends the body, up to the next heading of its level or above."""
    heads = list(_HEADING.finditer(text))
    if not heads:
        return "", text, ""
    first = heads[0].start()
    for h in reversed(heads[-3:]):
        line = text[h.start() : (text.find("\n", h.start()) + 1 or len(text) + 1) - 1]
        if "references" in line.lower() or "参考文献" in "".join(line.split()):
            level = len(h.group(1))
            later = [x.start() for x in heads if x.start() > h.start() and len(x.group(1)) <= level]
            end = later[0] if later else len(text)
            return text[first : h.start()] + text[end:], text[:first], text[h.start() : end]
    return text[first:], text[:first], ""


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, int, int]]] = []
        self.open: list[str] | None = None
        self.span = (1, 1)

    def _close(self):
        if self.open is not None:
            self.rows[-1].append(("".join(self.open).strip(), *self.span))
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            a = dict(attrs)
            self.span = tuple(int(a.get(k) or 1) if str(a.get(k) or 1).strip().isdigit() else 1 for k in ("colspan", "rowspan"))
            self.open = []
        elif tag == "br" and self.open is not None:
            self.open.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)


def table_to_markdown(html: str) -> str:
    """A table as a pipe table: a spanning cell's text stands in its first place, a
    space in the others; the first row is the head. Unchanged if it has no cells.
    A span that is no number counts as 1, one over 1,000 as that (HTML's own limit);
    no cell reaches below the last row."""
    p = _Cells()
    p.feed(html)
    p.close()
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(p.rows):
        c = 0
        for text, wide, high in row:
            while (r, c) in grid:
                c += 1
            high, wide = min(max(1, high), len(p.rows) - r), min(max(1, wide), 1000)
            for i in range(high):
                for j in range(wide):
                    grid[r + i, c + j] = text if i == j == 0 else " "
            c += wide
    if not grid:
        return html
    width, height = max(c for _, c in grid) + 1, len(p.rows)
    lines = ["| " + " | ".join(grid.get((r, c), " ") for c in range(width)) + " |" for r in range(height)]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def convert_tables(text: str) -> str:
    return _TABLE.sub(lambda m: table_to_markdown(m.group()), text)


def heading_sections(text: str) -> list[str]:
    """Pieces that begin at lines whose first visible character is #."""
    out: list[list[str]] = []
    for line in text.splitlines(keepends=True):
        if not out or line.lstrip().startswith("#"):
            out.append([line])
        else:
            out[-1].append(line)
    return list(map("".join, out))


def _cut(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut behind the last line's end, else
    the last space, else hard."""
    out = []
    while len(text) > most:
        at = text.rfind("\n", 0, most) + 1 or text.rfind(" ", 0, most) + 1 or most
        out.append(text[:at])
        text = text[at:]
    return out + [text] if text else out


def _segments(text: str) -> list[tuple[bool, str]]:
    """(is a formula, text) in turn; they add up to the text."""
    out, at = [], 0
    for m in _FORMULA.finditer(text):
        if m.start() > at:
            out.append((False, text[at : m.start()]))
        out.append((True, m.group()))
        at = m.end()
    return out + [(False, text[at:])] if at < len(text) else out


def chunk_by_headings(text: str, most: int = 2048) -> list[str]:
    """Sections by heading; one over `most` characters is cut so that no formula
    is: short parts are joined, a formula that doesn't fit stands alone, a long
    text part is cut by lines. The pieces add up to the text."""
    out: list[str] = []
    for section in heading_sections(text):
        if len(section) <= most:
            out.append(section)
            continue
        held = ""
        for formula, part in _segments(section):
            if len(held) + len(part) <= most:
                held += part
                continue
            if held:
                out.append(held)
                held = ""
            if formula:
                out.append(part)
            elif len(part) <= most:
                held = part
            else:
                out += _cut(part, most)
        if held:
            out.append(held)
    return out


def chunk_by_tokens(text: str, most: int, count: Callable[[str], int]) -> list[str]:
    """Chunks of at most `most` tokens by sections, then paragraphs, then parts
    that spare formulas; a formula over the limit stands alone."""
    if count(text) <= most:
        return [text] if text else []
    parts: list[str] = []
    for section in heading_sections(text):
        if count(section) <= most:
            parts.append(section)
            continue
        for paragraph in re.split(r"(\n\s*\n)", section):
            if not paragraph:
                continue
            if count(paragraph) <= most:
                parts.append(paragraph)
                continue
            for formula, piece in _segments(paragraph):
                parts += [piece] if formula else _cut_tokens(piece, most, count)
    out, held, size = [], "", 0
    for p in parts:
        n = count(p)
        if held and size + n > most:
            out.append(held)
            held, size = "", 0
        held, size = held + p, size + n
    return out + [held] if held.strip() else out


def _cut_tokens(text: str, most: int, count: Callable[[str], int]) -> list[str]:
    """Halves at a line's end or space until each part fits."""
    if count(text) <= most or len(text) < 2:
        return [text]
    middle = len(text) // 2
    at = text.rfind("\n", 1, middle) + 1 or text.rfind(" ", 1, middle) + 1 or middle
    return _cut_tokens(text[:at], most, count) + _cut_tokens(text[at:], most, count)


def word_count(text: str) -> int:
    """The default count: CJK characters, and other words."""
    return len(re.findall(r"[一-鿿]|[^\s一-鿿]+", text))


def _arrow(f: Callable[[str], object], kind: pa.DataType, ddl: str):
    def run(x: pa.Array) -> pa.Array:
        # a few texts at a time as Python's objects, which take several times the batch
        made = [pa.array([None if t is None else f(t) for t in x.slice(at, 200).to_pylist()], kind) for at in range(0, len(x), 200)]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl)


def tables_to_markdown(t: Column) -> Column:
    """Only texts with a table go to Python."""
    return F.when(F.regexp_like(t, F.lit("(?i)<table")), _arrow(convert_tables, pa.string(), "string")(F.when(F.regexp_like(t, F.lit("(?i)<table")), t))).otherwise(t)


def trimmed_paper(t: Column) -> Column:
    kind = pa.struct([(n, pa.string()) for n in ("body", "before_first_heading", "references_section")])
    f = lambda x: dict(zip(("body", "before_first_heading", "references_section"), trim_paper(x)))
    return _arrow(f, kind, "struct<body: string, before_first_heading: string, references_section: string>")(t)


def heading_chunks(t: Column, most: int = 2048) -> Column:
    return _arrow(lambda x: chunk_by_headings(x, most), pa.list_(pa.string()), "array<string>")(t)


def token_chunks(t: Column, most: int = 15_000, count: Callable[[str], int] = word_count) -> Column:
    return _arrow(lambda x: chunk_by_tokens(x, most, count), pa.list_(pa.string()), "array<string>")(t)


def counted_chunks(t: Column, most: int = 15_000, count: Callable[[str], int] = word_count) -> Column:
    """token_chunks() with each one's tokens, array<struct<text, n>>, in one pass through Python."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("n", pa.int32())]))
    return _arrow(lambda x: [{"text": c, "n": count(c)} for c in chunk_by_tokens(x, most, count)], kind, "array<struct<text: string, n: int>>")(t)


def token_count(t: Column, count: Callable[[str], int]) -> Column:
    """Tokens by a tokenizer's function; null is 0."""
    return F.coalesce(_arrow(count, pa.int32(), "int")(t), F.lit(0))
