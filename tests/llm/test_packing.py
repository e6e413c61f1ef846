"""Packing: every byte once, no bin over capacity, near the least number of bins."""

import random

import pytest

from grainmill.llm import packing as P


def plain(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in rooms if r >= s), default=None)
        if fit is None:
            rooms.append(capacity - s)
        else:
            rooms[rooms.index(fit)] -= s
    return len(rooms)


def test_best_fit_equals_a_plain_one():
    rng = random.Random(9)
    for _ in range(40):
        sizes = sorted((rng.randrange(1, 100) for _ in range(rng.randrange(1, 80))), reverse=True)
        bins = P.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) == plain(sizes, 100)


@pytest.mark.parametrize("parts", [1, 20])
def test_rounds(spark, parts, monkeypatch):
    rng = random.Random(10)
    lengths = [rng.choice((0, 1, 5, 40, 99, 100, 101, 250, rng.randrange(1, 130))) for _ in range(900)]
    docs = spark.createDataFrame([(k, "", n) for k, n in enumerate(lengths)], "doc_id bigint, text string, n bigint")
    monkeypatch.setattr(P, "PER_PARTITION", -(-900 // parts))
    rows = P.pack(docs, 100, "n").collect()
    bins, docs_ = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        docs_.setdefault(r.doc_id, []).append((r.start, r.length))
    for b in bins.values():
        b.sort(key=lambda r: r.slot)
        at = 0
        for k, r in enumerate(b):
            assert (r.slot, r.bin_start) == (k, at)
            at += r.length
        assert at == b[0].filled <= 100
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(docs_[k]):
            assert start == at
            at += length
        assert at == n
    assert len(bins) <= 1.03 * sum(lengths) / 100 + 2
    assert rows and sorted(map(str, P.pack(docs.repartition(5), 100, "n").collect())) == sorted(map(str, rows))


def test_special_cases(spark):
    rows = [(1, None), (2, ""), (None, "abc"), (None, "abc"), (3, "x" * 500), (3, "x" * 500), (4, "é" * 30)] + [(None, "n" * k) for k in range(40)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, bin_id string")
    got = P.pack(docs, 100).collect()
    total = {}
    for r in got:
        total.setdefault((r.doc_id, r.copy), []).append(r.length)
    assert {k: sum(v) for k, v in total.items() if k[0]} == {(1, 0): 1, (2, 0): 1, (3, 0): 501, (3, 1): 501, (4, 0): 61}
    assert sorted(sum(v) for k, v in total.items() if not k[0]) == sorted([4, 4, *range(1, 41)])
    odd = spark.createDataFrame([(1, -5), (2, None), (3, 7)], "doc_id bigint, n int")
    assert {(r.doc_id, r.length) for r in P.pack(odd, 100, "n").collect()} == {(1, 0), (2, 0), (3, 7)}
    assert P.pack(docs.limit(0), 100).collect() == []
