"""Template removal against counting by brute force; WARC derivatives and their round trip."""

import re
import time
from collections import Counter, defaultdict

import duckdb

from grainmill.llm import html_templates as H
from grainmill.llm import queries, warc

PAGE = "<html><body><nav><ul><li>Home<li>News</ul></nav><div><p>Story {k} &amp; more<p>second</div><footer>(c) site</footer></body></html>"


def pages(n, host="a.example", start=0):
    return [(start + k, f"https://{host}/p/{k}", PAGE.format(k=k)) for k in range(n)]


def bare(part):
    """A subtree's source without its tags' attributes, but for those of scripts and styles."""
    out, at = [], 0
    for m in re.finditer(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?[a-z][a-z0-9:-]*([^<>]*)>", part):
        if m.group(2):
            out.append(part[at : m.start(2)])
            at = m.end(2)
    return "".join(out) + part[at:]


def brute(rows):
    seen, count, total = set(), defaultdict(Counter), Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        if html and (host, html) not in seen:
            seen.add((host, html))
            total[host] += 1
            count[host].update({bare(html[a:b]) for a, b in H.subtrees(html)})
    out = []
    for i, url, html in rows:
        host = url.split("/")[2]
        doomed = {s for s, n in count[host].items() if n >= H.MIN_PAGES}
        parts, at, n = [], 0, 0
        for a, b in sorted(H.subtrees(html or "")):
            if a >= at and bare(html[a:b]) in doomed:
                parts += [html[at:a], "\n"]
                at, n = b, n + 1
        out.append((i, n, H.render("".join(parts) + (html or "")[at:])))
    return sorted(out)


def test_subtrees():
    page = "<div><p>a<p>b<script>x('</div>')</script></div></section><ul><li>1<li>2</ul><td>open"
    assert [page[a:b] for a, b in H.subtrees(page)] == ["<p>a", "<script>x('</div>')</script>", "<p>b<script>x('</div>')</script>", "<div><p>a<p>b<script>x('</div>')</script></div>", "<li>1", "<li>2", "<ul><li>1<li>2</ul>", "<td>open"]


def test_both_ways_equal_brute_force(spark):
    rows = pages(12) + pages(3, "b.example", 50) + [(90, "https://a.example/p/0", PAGE.format(k=0))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.n_removed, r.text) for r in H.extract(df).collect())
    assert got == brute(rows)
    assert got == sorted((r.page_id, r.n_removed, r.text) for r in H.extract(df, broadcast_keys=-1).collect())
    assert dict((r[0], r[2]) for r in got)[3] == "Story 3 & more"
    assert "Home" in dict((r[0], r[2]) for r in got)[50]


def test_attributes_do_not_hide_a_template(spark):
    menu = lambda k: "<nav>" + "".join(f'<li class="{"now" if k == j else ""}"><a href="/{j}?from={k}">Part {j}</a>' for j in range(6)) + "</nav>"
    rows = [(k, "https://m.example/x", f"<body>{menu(k)}<p>Own words {k}</p></body>") for k in range(6)]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"Own words {k}" for k in range(6)]


def test_odd_pages_take_linear_time():
    for page in ("<a" * 500_000, "<div>" * 200_000, "<p" + " a" * 500_000, "<!--" * 250_000, "<div>" * 100_000 + "</p>" * 100_000, "<script>" * 100_000, "</script " * 100_000):
        at = time.time()
        H.strip(page, "h", lambda x: [False] * len(x))
        assert time.time() - at < 8, page[:20]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, "https://c.example/x", PAGE.format(k="same")) for k in range(30)]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 30 and all(r.n_removed == 0 and "Story same" in r.text for r in got)


def test_special_cases(spark):
    rows = [(1, None, "<p>x</p>"), (2, "no host", None), (None, "https://d.example", ""), (3, "https://USER@d.example:80/", "<div>" * 3000 + "deep"), (3, "https://USER@d.example:80/", "plain <b>text"), (4, "https://d.example", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, keys string")
    got = H.extract(df).collect()
    assert len(got) == 6 and {r.host for r in got} == {"", "d.example"}
    assert sorted(r.text[:10] for r in got) == sorted(["x", "", "", "deep", "plain text", "long long "])
    assert H.extract(df.limit(0)).collect() == []


def test_table(spark):
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/pages.parquet")
    assert sorted((r.page_id, r.n_removed, r.text) for r in H.extract(df).collect()) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_templates_of_a_large_host(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%://blog.tionsh.example.com/%'")
    rows = {(r.page_id, r.html) for r in df.collect()}
    on = defaultdict(set)
    for _, html in rows:
        for a, b in H.subtrees(html):
            if html.startswith(("<nav", "<footer"), a):
                on[html[a:b]].add(html)
    often = {s for s, n in on.items() if len(n) >= 5}
    text = {r.page_id: r.text for r in H.extract(df).collect()}
    hit = [(H.render(s), text[i]) for i, html in rows for s in often if s in html]
    assert len(hit) > 400
    assert not [i for i, (block, left) in enumerate(hit) if block in left]


RECORD = "record_id string, target_uri string, date string, status string, headers string, payload string, payload_digest string, block_digest string"


def test_warc_special_cases(spark):
    rows = [
        ("r1", "https://x", "2026-01-01T00:00:00Z", "HTTP/1.1 200 OK", "A: 1\r\nB: $2", '<html lang=en><title>T &amp;</title><p>Hi &lt;b&gt;<a href="u">l</a><script>no</script>', "sha1:ABC", "sha1:DEF"),
        (None, None, None, None, None, None, None, None),
        ("r2", "", None, "", "", "", "", None),
        ("r1", "https://x", None, None, None, "y" * 500_000, None, None),
        ("r3", "https://z", None, None, None, "<p>&#8217;&eacute;&#x4e2d; &amp;lt; &unknown; AT&T</p><!-- open", None, None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], RECORD + ", block string")
    got = warc.derive(df).collect()
    assert len(got) == 10
    own = {r.warc_type: r for r in got if r.refers_to == "r1" and r.date}
    assert own["conversion"].block == "Hi <b>l"
    assert own["metadata"].block == "title: T &amp;\r\nlanguage: \r\noutlink: u\r\nsource-status: HTTP/1.1 200 OK\r\nsource-A: 1\r\nsource-B: $2\r\nsource-payload-digest: sha1:ABC\r\nsource-block-digest: sha1:DEF\r\n"
    assert own["metadata"].payload_digest == own["conversion"].payload_digest == "sha1:ABC"
    assert own["metadata"].concurrent_to == own["conversion"].record_id and own["conversion"].concurrent_to == own["metadata"].record_id
    assert next(r.block for r in got if r.refers_to == "r3" and r.warc_type == "conversion") == "’é中 &lt; &unknown; AT&T"
    assert len({r.record_id for r in got if r.refers_to == "r1"}) == 2  # captures of one id stay so
    assert all(r.record_id.startswith("<urn:uuid:") and r.content_length == len(r.block.encode()) for r in got)
    assert warc.derive(df.limit(0)).collect() == []


def warc_record(kind, ident, http, more=""):
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Target-URI: https://y\r\n%sContent-Length: %d\r\n\r\n" % (kind.encode(), ident.encode(), more.encode(), len(http)) + http + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    import gzip
    import hashlib
    import zlib

    latin = "<p>caf\xe9</p>".encode("latin-1")
    packed, chunked = gzip.compress("<p>zip é</p>".encode()), b"7\r\n<p>chun\r\n6\r\nk</p>\n\r\n0\r\n\r\n"
    http = lambda head, body: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    sources = {
        "<urn:uuid:1>": (http(b"Content-Type: text/html; charset=ISO-8859-1", latin), "WARC-Payload-Digest: sha1:SOURCE\r\n", "<p>café</p>"),
        "<urn:uuid:2>": (http(b"Content-Type: text/html\r\nContent-Encoding: gzip", packed), "", "<p>zip é</p>"),
        "<urn:uuid:3>": (http(b"Content-Type: text/html\r\nTransfer-Encoding: chunked", chunked), "", "<p>chunk</p>\n"),
        "<urn:uuid:4>": (http(b"Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(b"<p>flat</p>")), "", "<p>flat</p>"),
        "<urn:uuid:5>": (http(b"Content-Type: text/html", b"<p>" + b"long " * 600_000), "", "<p>" + "long " * 600_000),
    }
    raw = [warc_record("response", i, h, more) for i, (h, more, _) in sources.items()] + [warc_record("request", "<urn:uuid:8>", b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw[:3]))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(raw[3:]))
    df = warc.read_warc(spark, str(tmp_path / "in"))
    got = {r.record_id: r for r in df.collect()}
    assert set(got) == set(sources)
    for i, (h, more, text) in sources.items():
        r, body = got[i], h.partition(b"\r\n\r\n")[2]
        assert r.payload == text and r.status == "HTTP/1.1 200 OK" and r.headers.startswith("Content-Type: text/html")
        assert r.payload_digest == ("sha1:SOURCE" if more else "sha256:" + hashlib.sha256(body).hexdigest())
        assert r.block_digest == "sha256:" + hashlib.sha256(h).hexdigest()
    made = warc.write_warc(warc.derive(df), str(tmp_path / "w")).collect()
    assert sum(r.records for r in made) == 10
    records = [x for r in made for x in warc.parse((tmp_path / "w" / r.file).read_bytes())]
    assert sorted(x["headers"]["warc-refers-to"] for x in records) == sorted([*sources, *sources])
    ids = {x["headers"]["warc-record-id"]: x["headers"] for x in records}
    for x in records:
        h = x["headers"]
        assert ids[h["warc-concurrent-to"]]["warc-refers-to"] == h["warc-refers-to"]
        assert h["warc-source-payload-digest"] == got[h["warc-refers-to"]].payload_digest and h["warc-source-status"] == "HTTP/1.1 200 OK"
        assert h["warc-block-digest"] == "sha256:" + hashlib.sha256(x["block"]).hexdigest()
    assert {x["block"].decode() for x in records if x["headers"]["warc-type"] == "conversion"} == {"café", "zip é", "chunk", "flat", ("long " * 600_000).strip()}


def test_warc_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    q = queries.op10_warc_derivatives(spark, d)
    want = c.execute(warc.sql())
    names = [x[0] for x in want.description]
    assert names == q.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in q.collect())
