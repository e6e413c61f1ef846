"""HTML extraction with site template removal.

Every block element of a page is a subtree, hashed by its tags' names and its
text: attributes don't count, so the menu whose entry of the day is marked is
the same menu. One hash of each beginning of a page gives those of all its
subtrees, so parsing and hashing take time in proportion to the page, however
deeply it is nested. Spark counts on how many different pages of its host each subtree occurs; one that occurs on
MIN_PAGES of them at least belongs to the site's template, however large the
host is: a large site has many templates, each on a small share of its pages.
Template subtrees are deleted, the outermost first, and what is left is rendered
as text.

Pages of equal source count once, so a page that was crawled many times is
not taken for a template. The count is a two-step aggregation of 16-byte keys;
a host of any number of pages is one key among others for each subtree.

The template keys are sent to all executors while they are at most
BROADCAST_KEYS; beyond that each page's own keys are joined with them and
come to the page by its digest.

Results for special cases:
* null or empty html: empty text, nothing removed; it doesn't count as a page;
* null url, or one without a host: the host is the empty string, a host like others;
* null page_id and repeated rows: each row has its result;
* unclosed and misnested elements: closed where a parent closes, at the latest
  at the end; end tags without a beginning are skipped; a tag holds no "<";
* very long pages: parsed whole, in time that grows like their length;
* ties: a count reached exactly counts; an empty table gives an empty result;
* other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import materialise

MIN_PAGES = 5
#: The share of the host's pages that is asked for besides: none. Only recounts read it.
SHARE = 0.0
BROADCAST_KEYS = 4_000_000

_BLOCKS = frozenset(
    """address article aside blockquote button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header iframe li main menu nav noscript ol p pre script section select style svg table tbody td th thead tfoot tr ul""".split()
)
_CLOSES = {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)([^<>]*)>", re.I | re.S)
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:br|hr|body|head|html|" + "|".join(sorted(_BLOCKS)) + r")\b[^<>]*>", re.I)
_ANY = re.compile(r"<[!/]?[a-z][^<>]*>", re.I)


def parse(page: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of each block element of a page, in the order of their ends, and of the attributes of its tags."""
    out: list[tuple[int, int]] = []
    attributes: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    is_open: Counter[str] = Counter()

    def close(end: int) -> str:
        name, start = stack.pop()
        is_open[name] -= 1
        out.append((start, end))
        return name

    for m in _TAG.finditer(page):
        if m.group(1):
            out.append(m.span())
            continue
        name = m.group(3)
        if name is None:
            continue
        if m.group(4):
            attributes.append(m.span(4))
        if (name := name.lower()) not in _BLOCKS:
            continue
        if not m.group(2):
            closes = _CLOSES.get(name, {"p"})
            while stack and stack[-1][0] in closes:
                close(m.start())
            stack.append((name, m.start()))
            is_open[name] += 1
        elif is_open[name]:
            while stack[-1][0] != name:
                close(m.start())
            close(m.end())
    while stack:
        close(len(page))
    return out, attributes


def subtrees(page: str) -> list[tuple[int, int]]:
    return parse(page)[0]


_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _M1
    x = (x ^ (x >> _U(29))) * _M2
    return x ^ (x >> _U(32))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, up to n at least."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(2 * n + 1024, b, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def hashes(page: str, host: str, spans: list[tuple[int, int]], attributes: list[tuple[int, int]]) -> np.ndarray:
    """A hash of each span's characters without those in attributes, from one running polynomial."""
    import xxhash

    if not spans:
        return np.zeros(0, np.int64)
    c = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.zeros(len(c) + 1, np.int32)
    if attributes:
        a = np.array(attributes)
        edge[a[:, 0]] += 1
        edge[a[:, 1]] -= 1
    use = np.cumsum(edge[:-1]) == 0
    at = np.concatenate(([0], np.cumsum(use)))
    v = _mix((c[use].astype(_U) + _U(1)) * _GOLD)
    up, down = _power(len(v))
    run = np.concatenate((np.zeros(1, _U), np.cumsum(v * up[: len(v)], dtype=_U)))
    s = np.array(spans)
    begin, end = at[s[:, 0]], at[s[:, 1]]
    seed = _U(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))
    return _mix(((run[end] - run[begin]) * down[begin] + (end - begin).astype(_U) * _GOLD) ^ seed).view(np.int64)


def _keys(page: str, host: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans, attributes = parse(page)
    return spans, hashes(page, host, spans, attributes)


def render(page: str) -> str:
    """The text of a page: a line for each block, entities decoded."""
    text = _html.unescape(_ANY.sub("", _BREAK.sub("\n", _DROP.sub(" ", page))))
    return "\n".join(filter(None, (" ".join(x.split()) for x in text.split("\n"))))


def strip(page: str, host: str, doomed) -> tuple[str, int, int]:
    """(text, subtrees deleted, characters deleted); doomed: which of some keys are templates."""
    spans, keys = _keys(page, host)
    cut = sorted(s for s, d in zip(spans, doomed(keys)) if d)
    parts, at, n, chars = [], 0, 0, 0
    for a, b in cut:
        if a >= at:
            parts += [page[at:a], "\n"]
            at, n, chars = b, n + 1, chars + b - a
    return render("".join(parts) + page[at:]), n, chars


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.unique(_keys(p, h)[1]) for h, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["host", "digest", "keys"])


_OUT = "page_id bigint, host string, n_removed int, chars_removed int, text string"


def _result(batch: pa.RecordBatch, made: list[tuple[str, int, int]]) -> pa.RecordBatch:
    text, n, chars = zip(*made) if made else ((), (), ())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(chars, pa.int32()), pa.array(text, pa.string())], names=["page_id", "host", "n_removed", "chars_removed", "text"])


def _with_set(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = keys.value

        def doomed(x: np.ndarray) -> np.ndarray:
            at = np.searchsorted(own, x)
            return (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == x) if len(own) else np.zeros(len(x), bool)

        for batch in batches:
            yield _result(batch, [strip(p or "", h, doomed) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])

    return run


def _with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for h, p, own in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            own = np.array(own or (), np.int64)
            made.append(strip(p or "", h, lambda x, own=own: np.isin(x, own)))
        yield _result(batch, made)


def extract(pages: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(page_id, host, n_removed, chars_removed, text) for every page."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(F.col("url")).alias("host"), "html")
    digest = F.xxhash64("host", "html")
    some = rows.where(F.length("html") > 0)
    marks = some.select("host", digest.alias("digest"), "html").mapInArrow(_mark, "host string, digest bigint, keys array<bigint>")
    marks = materialise(marks.groupBy("digest").agg(F.first("host").alias("host"), F.first("keys").alias("keys")), "marks")
    counted = marks.select(F.xxhash64("host").alias("h"), F.explode("keys").alias("key")).groupBy("h", "key").agg(F.count("*").alias("n"))
    template = counted.where(F.col("n") >= MIN_PAGES).select("key")
    template = materialise(template.distinct(), "template")
    if template.count() <= broadcast_keys:
        keys = template.toArrow().column("key").to_numpy()
        return rows.mapInArrow(_with_set(spark.sparkContext.broadcast(np.sort(keys))), _OUT)
    own = marks.select("digest", F.explode("keys").alias("key")).join(template, "key").groupBy("digest").agg(F.collect_list("key").alias("keys"))
    joined = rows.withColumn("digest", digest).join(own, "digest", "left").select("page_id", "host", "html", "keys")
    return joined.mapInArrow(_with_own, _OUT)
