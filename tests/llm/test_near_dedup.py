"""BagMinHash near-dedup: unbiased signatures, exact components, special cases."""

import random
from collections import Counter

import numpy as np

from grainmill.llm import near_dedup as N
from tests.conftest import SF


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def jaccard(a, b):
    x, y = (Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w) for w in (a.lower().split(), b.lower().split()))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(docs, threshold=N.THRESHOLD):
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a.split() and b.split() and jaccard(a, b) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i, _ in docs if find(i) != i}


def edited(rng, w, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


def test_overlap_counts_multisets():
    rng = random.Random(1)
    for _ in range(30):
        a = words(rng, rng.randrange(1, 60), 9)
        b = edited(rng, a, 0.2)
        assert abs(N.overlap(N.bigrams(" ".join(a)), N.bigrams(" ".join(b))) - jaccard(" ".join(a), " ".join(b))) < 1e-12


def test_signatures_are_unbiased_and_do_not_depend_on_company():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        a = words(rng, 200, 40)
        b = edited(rng, a, rng.choice((0.02, 0.1, 0.3)))
        texts = [" ".join(a), " ".join(b), "x", " ".join(words(rng, 50))]
        s = N.signatures(*N.bags(texts))
        alone = N.signatures(*N.bags(texts[1:2]))
        assert (s[1] == alone[0]).all()
        errors.append((s[0] == s[1]).mean() - jaccard(texts[0], texts[1]))
    assert abs(np.mean(errors)) < 0.02


def test_weights_matter():
    a, b = "a b " * 8, "a b " * 4
    many = [(f"{k} ".join(a.split()), f"{k} ".join(b.split())) for k in range(150)]
    rate = np.mean([(s := N.signatures(*N.bags([x + f" q{k}", y + f" q{k}"])))[0] == s[1] for k, (x, y) in enumerate(many)])
    exact = np.mean([jaccard(x + f" q{k}", y + f" q{k}") for k, (x, y) in enumerate(many)])
    assert abs(rate - exact) < 0.03


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    docs, i = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(30, 200))
        for k in range(rng.randrange(1, 6)):
            docs.append((i, " ".join(edited(rng, base, 0.03 * (k > 0)))))
            i += 1
    for k in range(40):  # a hot group of copies and near copies
        docs.append((i, " ".join(edited(rng, base, 0.02 * (k % 3 == 0)))))
        i += 1
    rng.shuffle(docs)
    got = {tuple(r) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(docs)


def test_hot_bands_give_the_same(spark, monkeypatch):
    """Documents that share most of their words with all others: many in a band, few alike."""
    rng = random.Random(4)
    common = words(rng, 60)
    docs = []
    for k in range(300):
        own = words(rng, 40, 10**6)
        docs += [(4 * k + j, " ".join(common + edited(rng, own, 0.05 * j))) for j in range(2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute(docs)
    monkeypatch.setattr(N, "HOT", 4)
    monkeypatch.setattr(N, "TILE", 50)
    got = {tuple(r) for r in N.near_duplicates(df).collect()}
    assert len(want) > 200 and len(got ^ want) <= 0.02 * len(want)
    assert (N.agreement(0.55), N.agreement(0.01)) == (38, 1)


def test_special_cases(spark):
    long = " ".join(f"z{k}" for k in range(60_000))
    rows = [(1, None, 0), (2, "", 0), (3, "  \n ", 0), (4, "one", 0), (5, "one", 0), (6, "ONE\n", 0), (None, "one", 0), (7, long, 0), (8, long + " end", 0), (9, "solo text here", 0), (9, "solo text here", 0), (10, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, band int").withColumnRenamed("band", "digest")
    got = {tuple(r) for r in N.near_duplicates(docs).collect()}
    assert got == {(5, 4), (6, 4), (8, 7)}
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {tuple(r) for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(k, 0) for k in range(1, 41)} | {(101, 100), (102, 100)}


def test_only_the_result_stays_written(spark):
    from pathlib import Path

    from grainmill.llm._common import scratch_root

    root = Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.glob("*"))
    got = N.near_duplicates(spark.createDataFrame([(k, "one two three four") for k in range(5)], "doc_id bigint, text string"))
    assert [p.name.split("-")[0] for p in set(root.glob("*")) - before] == ["duplicates"]
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(1, 5)}


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in N.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
