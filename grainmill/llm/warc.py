"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record is (record_id, target_uri, date, status, headers, payload,
payload_digest, block_digest): status is the source's HTTP status line, headers
are its header lines as they came, payload is its body as text, and the digests
are those that the source itself states or, for want of one, those of its bytes
(read_warc computes them before it decodes anything). Each response yields two
records that refer to it and to one another:

* metadata (application/warc-fields): title, language, links, and the source's
  status, headers and digests as they came;
* conversion (text/plain): the page as text.

Both carry the source's record id as refers_to, its URI, date, status, headers
and digests, the other's record id as concurrent_to, and the digest and length of
their own block; written as WARC records they state all of them. Record ids are
uuids of the source's id and the type, so a second run makes the same records.
derive() has no shuffle and is built-in expressions, but for pages with a rare
character reference (not one of COMMON), whose text goes through Python.

Results for special cases:
* null or empty payload: both records are made; the text is empty;
* null uri, date, status or headers: null in both records; links and title absent;
* null source digests: the payload's digest is that of its UTF-8 bytes, the
  block's stays null;
* null record_id: a null refers_to, and ids from the uri and payload alone;
* repeated rows: each yields its records, of equal ids; a record_id that repeats
  with another payload names two captures alike in the source, and so here;
* very long payloads: converted whole; unclosed tags, comments and scripts end
  with the page;
* ties: there is nothing to choose between; an empty table gives an empty result;
* other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import html as _html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
#: In this order; all of them read alike in Java's and RE2's syntax.
_TAGS = (
    (r"(?is)<(?:script\b[^<>]*>.*?(?:</script\s*>|\z)|style\b[^<>]*>.*?(?:</style\s*>|\z)|title\b[^<>]*>.*?(?:</title\s*>|\z)|!--.*?(?:-->|\z))", " "),
    (rf"(?i)</?(?:{_BLOCK})\b[^<>]*>", "\n"),
    (r"<[!/]?[A-Za-z][^<>]*>", ""),
)
#: Character references that are replaced by expressions; "&amp;" comes last, so nothing is decoded twice.
COMMON = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_RARE = r"&(?!(?:nbsp|lt|gt|quot|#39|apos|copy|middot|amp);)(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _steps(t: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in steps:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(by))
    return t


def references(text: str) -> str:
    """Every character reference that ends in ";" decoded, once."""
    return _REFERENCE.sub(lambda m: COMMON.get(m.group()) or _html.unescape(m.group()).replace("\xa0", " "), text)


def with_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """df with the text of its column html; steps are columns of their own, so each is computed once."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else references(t) for t in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    own = df.withColumn("__bare", _steps(F.col(html), _TAGS)).withColumn("__rare", F.regexp_like("__bare", F.lit(_RARE)))
    plain = F.col("__bare")
    for name, by in COMMON.items():
        plain = F.replace(plain, F.lit(name), F.lit(by))
    decoded = F.when(F.col("__rare"), F.arrow_udf(run, "string")(F.when(F.col("__rare"), F.col("__bare")))).when(F.contains("__bare", F.lit("&")), plain).otherwise(F.col("__bare"))
    for c in "\t\r\f":
        decoded = F.replace(decoded, F.lit(c), F.lit(" "))
    # plain replacement where it will do: a pattern costs a conversion of the text each way
    own = own.withColumn("__plain", decoded)
    own = own.withColumn("__plain", F.when(F.contains("__plain", F.lit("  ")), F.regexp_replace("__plain", " {2,}", " ")).otherwise(F.col("__plain")))
    lines = F.replace(F.replace("__plain", F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return own.withColumn(out, F.trim(F.regexp_replace(lines, "\n{2,}", "\n"), F.lit(" \n"))).drop("__bare", "__rare", "__plain")


def urn(x: Column) -> Column:
    """A record id: the 128 bits of x's md5 written as a uuid."""
    h = F.md5(x)
    return F.concat(F.lit("<urn:uuid:"), *[p for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for p in ((F.lit("-"),) if k else ()) + (F.substring(h, a, n),)], F.lit(">"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of the pages table, which holds no dates, status lines or
    digests; the header lines are those that a capture of such a page has."""
    body, none = F.coalesce("html", F.lit("")), F.lit(None).cast("string")
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        urn(F.concat(F.lit("response|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        none.alias("date"),
        none.alias("status"),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string")).alias("headers"),
        body.alias("payload"),
        none.alias("payload_digest"),
        none.alias("block_digest"),
    )


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The two derivatives of each response record; keep: columns to carry along."""
    body = F.coalesce("payload", F.lit(""))
    first = lambda p: F.regexp_extract("body", p, 1)
    base = records.select(*keep, "record_id", "target_uri", "date", "status", "headers", F.coalesce("payload_digest", digest(body)).alias("pd"), F.col("block_digest").alias("bd"), body.alias("body"))
    title = F.regexp_replace(first(r"(?is)<title\b[^<>]*>(.*?)</title"), r"[ \t\r\n]+", " ")
    links = F.expr(r"""regexp_extract_all(body, '(?i)<a\\b[^<>]*href="([^"<>]*)"', 1)""")
    line = lambda name, x: F.when(F.length(x) > 0, F.concat(F.lit(f"\r\n{name}: "), x)).otherwise("")
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), first(r'(?i)<html\b[^<>]*lang="([A-Za-z-]*)"'),
        F.concat_ws("", F.transform(links, lambda x: F.concat(F.lit("\r\noutlink: "), x))),
        line("source-status", F.col("status")),
        F.when(F.length("headers") > 0, F.concat(F.lit("\r\n"), F.regexp_replace("headers", r"(?m)^", "source-"))).otherwise(""),
        line("source-payload-digest", F.col("pd")), line("source-block-digest", F.col("bd")),
        F.lit("\r\n"),
    )
    name = lambda kind: urn(F.concat(F.lit(kind + "|"), F.coalesce("record_id", F.concat(F.coalesce("target_uri", F.lit("")), F.lit("|"), F.md5("body")))))
    own = with_text(base.withColumns({"m": name("metadata"), "c": name("conversion"), "f": fields}), "body", "text").drop("body")
    of = lambda kind, mime, block, this, other: F.struct(F.lit(kind).alias("t"), F.lit(mime).alias("c"), block.alias("b"), F.col(this).alias("i"), F.col(other).alias("o"))
    both = own.select("*", F.explode(F.array(of("metadata", "application/warc-fields", F.col("f"), "m", "c"), of("conversion", "text/plain", F.col("text"), "c", "m"))).alias("r"))
    return both.select(
        *keep, F.col("r.i").alias("record_id"), F.col("r.t").alias("warc_type"), F.col("record_id").alias("refers_to"), F.col("r.o").alias("concurrent_to"), "target_uri", "date", F.col("r.c").alias("content_type"),
        F.col("status").alias("source_status"), F.col("headers").alias("source_headers"), F.col("pd").alias("payload_digest"), F.col("bd").alias("source_block_digest"), digest(F.col("r.b")).alias("block_digest"),
        F.octet_length("r.b").cast("bigint").alias("content_length"), F.col("r.b").alias("block"),
    )


def record_bytes(r: dict) -> bytes:
    """A derivative as a WARC/1.1 record; what the source stated has names of its own."""
    block = (r["block"] or "").encode("utf-8", "surrogatepass")
    lines = [
        ("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Concurrent-To", r["concurrent_to"]), ("WARC-Target-URI", r["target_uri"]),
        ("WARC-Date", r["date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["payload_digest"]), ("WARC-Source-Block-Digest", r["source_block_digest"]),
        ("WARC-Source-Status", r["source_status"]), *(("WARC-Source-Header", x) for x in (r["source_headers"] or "").split("\r\n") if x),
        ("Content-Type", r["content_type"]), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write_warc(records: DataFrame, out: str) -> DataFrame:
    """Writes derivatives to .warc.gz files, a gzip member a record, one file a
    partition, and returns (file, records). Lazy; a task that runs again
    leaves a file of another name, and the result names the one that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        c, n = TaskContext.get(), 0
        name = f"part-{c.partitionId():06d}-{c.taskAttemptId()}.warc.gz"
        system, path = fs.FileSystem.from_uri((out if "://" in out else f"file://{out}") + f"/{name}")
        system.create_dir(path.rpartition("/")[0])
        with system.open_output_stream(path, compression=None) as sink:
            for b in batches:
                for r in b.to_pylist():
                    sink.write(gzip.compress(record_bytes(r), mtime=0))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return records.mapInArrow(run, "file string, records bigint")


class _Unpacked:
    """Reads a plain or gzip stream of any number of members, a piece at a time."""

    def __init__(self, source, piece: int = 1 << 20):
        self.source, self.piece, self.held, self.at = source, piece, b"", 0
        start = source.read(piece)
        self.zip = zlib.decompressobj(31) if start[:2] == b"\x1f\x8b" else None
        self._take(start)

    def _take(self, raw: bytes) -> None:
        got = []
        while self.zip and raw:
            try:
                got.append(self.zip.decompress(raw))
            except zlib.error:  # what follows is no archive
                raw = b""
                break
            raw = self.zip.unused_data
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        self.held = self.held[self.at :] + b"".join([*got, raw] if not self.zip else got)
        self.at = 0

    def _more(self) -> bool:
        raw = self.source.read(self.piece)
        if raw:
            self._take(raw)
        return bool(raw)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark; the stream goes on behind it."""
        begin = 0
        while (i := self.held.find(mark, self.at + begin)) < 0:
            begin = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                return None
        out, self.at = self.held[self.at : i], i + len(mark)
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
            if n and not self._more():
                break
        return b"".join(parts)


def parse(source) -> Iterator[dict]:
    """The records of a WARC file (bytes or a binary stream, plain or gzip): headers by lower-case name, and block."""
    import io

    own = _Unpacked(io.BytesIO(source) if isinstance(source, bytes) else source)
    while (version := own.until(b"\r\n")) is not None:
        if not version.startswith(b"WARC/"):
            continue
        if (head := own.until(b"\r\n\r\n")) is None:
            return
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
        n = headers.get("content-length", "")
        yield {"headers": headers, "block": own.exactly(int(n) if n.isdigit() else 0)}


def _body(body: bytes, headers: dict[str, str]) -> bytes:
    """A body without its transfer and content encodings; as it is where they don't hold."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            parts.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
            if not n:
                break
        body = b"".join(parts) if parts else body
    how = headers.get("content-encoding", "").lower()
    try:
        if how in ("gzip", "x-gzip"):
            return zlib.decompressobj(31).decompress(body)
        if how == "deflate":
            return zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
    except zlib.error:
        pass
    return body


_CHARSET = re.compile(rb"""<meta[^<>]{0,200}charset=["']?([A-Za-z0-9_.:-]+)""", re.I)


def decoded(body: bytes, headers: dict[str, str]) -> str:
    """The text of a body, by the charset of its header or first kilobytes, else UTF-8, else Latin-1."""
    body = _body(body, headers)
    named = re.search(r"charset=[\"']?([A-Za-z0-9_.:-]+)", headers.get("content-type", ""), re.I)
    own = _CHARSET.search(body, 0, 4096)
    for name in ((named.group(1),) if named else ()) + ((own.group(1).decode(),) if own else ()) + ("utf-8",):
        try:
            return body.decode(name)
        except (LookupError, ValueError):
            continue
    return body.decode("latin-1")


def _response(r: dict) -> tuple:
    h, (head, _, body) = r["headers"], r["block"].partition(b"\r\n\r\n")
    status, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split("\r\n"))}
    of = lambda stated, data: h.get(stated) or "sha256:" + hashlib.sha256(data).hexdigest()
    return h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), status, lines, decoded(body, http), of("warc-payload-digest", body), of("warc-block-digest", r["block"])


_RECORD = ("record_id", "target_uri", "date", "status", "headers", "payload", "payload_digest", "block_digest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files under path (plain or gzip), a file a row
    of work, streamed: a task holds one record at a time, whatever the file's size.
    payload is the decoded body; digests are the source's own or those of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)
                with system.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for r in parse(source):
                        if r["headers"].get("warc-type") == "response":
                            rows.append(_response(r))
                            size += len(r["block"])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(len(_RECORD))], names=list(_RECORD))
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(len(_RECORD))], names=list(_RECORD))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    spread = files.repartition(max(1, min(files.count(), 16 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(run, ", ".join(f"{c} string" for c in _RECORD))


_Q = lambda s: s.replace("'", "''")


def sql() -> str:
    """DuckDB's form of derive(responses(pages)), carrying page_id, for pages without rare references."""
    text = "body"
    for pattern, by in _TAGS:
        text = f"regexp_replace({text}, '{_Q(pattern)}', '{_Q(by)}', 'g')"
    for name, by in COMMON.items():
        text = f"replace({text}, '{name}', '{_Q(by)}')"
    for pattern, by in ((r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n+", "\n"), (r"^[ \n]+|[ \n]+$", "")):
        text = f"regexp_replace({text}, '{_Q(pattern)}', '{_Q(by)}', 'g')"
    uuid = lambda x: f"'<urn:uuid:' || substr(md5({x}),1,8) || '-' || substr(md5({x}),9,4) || '-' || substr(md5({x}),13,4) || '-' || substr(md5({x}),17,4) || '-' || substr(md5({x}),21,12) || '>'"
    crlf = "chr(13) || chr(10)"
    return rf"""
WITH r0 AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS body,
    {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS rid,
    'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) AS headers,
    'sha256:' || sha256(coalesce(html, '')) AS pd
  FROM pages
), r AS (SELECT *, {uuid("'metadata|' || rid")} AS m, {uuid("'conversion|' || rid")} AS c FROM r0), b AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, m AS record_id, c AS concurrent_to,
    'title: ' || regexp_replace(regexp_extract(body, '(?is)<title\b[^<>]*>(.*?)</title', 1), '[ \t\r\n]+', ' ', 'g')
    || {crlf} || 'language: ' || regexp_extract(body, '(?i)<html\b[^<>]*lang="([A-Za-z-]*)"', 1)
    || coalesce(array_to_string(list_transform(regexp_extract_all(body, '(?i)<a\b[^<>]*href="([^"<>]*)"', 1), lambda x: {crlf} || 'outlink: ' || x), ''), '')
    || {crlf} || regexp_replace(headers, '(?m)^', 'source-', 'g') || {crlf} || 'source-payload-digest: ' || pd || {crlf} AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain', c, m, {text} FROM r
)
SELECT page_id, record_id, warc_type, rid AS refers_to, concurrent_to, target_uri, CAST(NULL AS VARCHAR) AS date, content_type, CAST(NULL AS VARCHAR) AS source_status,
  headers AS source_headers, pd AS payload_digest, CAST(NULL AS VARCHAR) AS source_block_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM b"""
