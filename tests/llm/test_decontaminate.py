"""q-gram lemma filter against edit distance by brute force; special cases."""

import random

import numpy as np

from grainmill.llm import decontaminate as D


def nearest(segment, text):
    """Least edits of segment to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def phrase(rng, n, letters="abcdefgh éß中"):
    return " ".join("".join(rng.choice(letters) for _ in range(n)).split())


def damage(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        s[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("xyz")]
    return "".join(s)


def test_filter_loses_nothing():
    rng = random.Random(6)
    items = [(k, phrase(rng, rng.choice((22, 40, 70, 79, 150)))) for k in range(8)]
    index = D.Index(items)
    for trial in range(60):
        item = items[trial % len(items)][1]
        seg = rng.choice([s for i, s in index.segments if items[trial % len(items)][0] in i])
        text = D.normal(phrase(rng, rng.randrange(80)) + damage(rng, seg, rng.randrange(0, len(seg) // 7)) + phrase(rng, rng.randrange(80)))
        other = D.normal(phrase(rng, 60) + item)
        got = {(d, i) for d, i, *_ in D.search(index, [text, "", other])}
        want = {(d, i) for s in range(len(index.segments)) for d, t in ((0, text), (2, other)) for i in index.segments[s][0] if nearest(index.segments[s][1], t) <= index.k[s]}
        assert got == want


def test_alignment_equals_the_full_table():
    rng = random.Random(7)
    for _ in range(200):
        s, k = phrase(rng, 40, "abc "), 5
        region = phrase(rng, 8, "abc ") + damage(rng, s, rng.randrange(8)) + phrase(rng, 8, "abc ")
        n, got = nearest(s, region), D.align(s, region, k)
        assert (got[0] if got else None) == (n if n <= k else None)


def test_folding_keeps_equal_characters_equal():
    assert (D.fold("aé")[:1] == D.fold("a中")[:1]).all() and D.fold("é")[0] == D.fold("é中")[0]
    assert len(np.unique(D.fold("abcdefgh中国"))) > 8


PASSAGE = "the quick brown fox jumps over the lazy dog while the sun sets behind the distant hills of the north"


def test_special_cases(spark):
    long = "word " * 300_000
    docs = [(1, None), (2, ""), (3, PASSAGE.upper()), (3, PASSAGE.upper()), (4, "before " + PASSAGE.replace("fox", "cat") + " after"), (5, long + PASSAGE), (6, "Unrelated  text it is, said nobody"), (None, PASSAGE), (7, PASSAGE[:40]), (8, "to be it is"), (9, "tobe")]
    docs = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(10, PASSAGE), (10, PASSAGE), (11, None), (12, ""), (13, "be"), (None, "unrelated text it is, said nobody")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(docs, bench).collect()}
    assert got == {(3, 10): 0, (4, 10): 0, (5, 10): 0, (6, None): 0}
    assert [r.item_id for r in D.short_items(bench).collect()] == [13]
    assert D.leaks(docs.limit(0), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []


def test_slices_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, phrase(rng, 100)) for k in range(12)]
    docs = spark.createDataFrame([(k, phrase(rng, 50) + items[k % 12][1]) for k in range(30)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = {tuple(r) for r in D.leaks(docs, bench).collect()}
    monkeypatch.setattr(D, "SLICE", 300)
    assert len(D.indexes(bench)) > 3 and {tuple(r) for r in D.leaks(docs, bench).collect()} == one


def test_items_that_share_a_prompt_need_little_memory(monkeypatch):
    import resource

    rng = random.Random(9)
    prompt = phrase(rng, 140)[:100].ljust(100, "q")
    items = [(k, prompt + phrase(rng, 60, "abcdefghijklmnop")) for k in range(3000)]
    index = D.Index(items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {i for _, i, *_ in D.search(index, [D.normal("x " * 2000 + items[5][1] + " y" * 2000)])}
    assert len(found) == 3000  # all share the prompt's first segment
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000
    some = D.Index(items[:40])
    text = D.normal(" ".join(items[k][1] + phrase(rng, 80) for k in (3, 5, 9)))
    one = sorted(D.search(some, [text]))
    monkeypatch.setattr(D, "PIECE", 500)
    assert sorted(D.search(some, [text])) == one


def test_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    # every segment against every text, by full tables of edit distances over arrays
    index = D.Index([(r.item_id, r.text) for r in bench.collect()])
    want = set()
    for doc, text in {(r.doc_id, D.normal(r.text)) for r in docs.collect()}:
        t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        by_length = {}
        for n, (_, seg) in enumerate(index.segments):
            by_length.setdefault(len(seg), []).append(n)
        for m, own in by_length.items():
            p = np.stack([np.frombuffer(index.segments[n][1].encode("utf-32-le"), np.uint32) for n in own])
            row, step = np.zeros((len(own), len(t) + 1), np.int16), np.arange(len(t) + 1, dtype=np.int16)
            for i in range(m):
                new = np.empty_like(row)
                new[:, 0] = i + 1
                new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (t != p[:, i, None]))
                row = np.minimum.accumulate(new - step, axis=1) + step
            for n, least in zip(own, row.min(axis=1)):
                if least <= index.k[n]:
                    want |= {(doc, item) for item in index.segments[n][0]}
    assert want and got == want


def test_table(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    texts = [(r.doc_id, D.normal(r.text)) for r in docs.collect()]
    exact = {(i, b.item_id) for b in bench.collect() for i, t in texts if D.normal(b.text) in t}
    assert exact and exact <= got
