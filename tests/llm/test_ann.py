"""Rotated one-bit codes: unbiased estimates, bounds, recall against brute force."""

import numpy as np
import pytest

from grainmill.llm import ann as A


def test_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 96)) * rng.uniform(0.1, 3, (3000, 1)), rng.standard_normal((20, 96)) * 2
    turn = A.rotation(96)
    c = A.Codes(x, turn)
    true = ((q[:, None] - x) ** 2).sum(axis=2)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    right = np.concatenate((q @ turn, np.ones((20, 1)), size), axis=1)
    low = right @ A.columns(c.bits, c.norm, c.own, 96).T + size**2
    slack = 2 * c.norm * size * A.spread(96, c.own)  # the estimate is half of it above the bound
    error = (low + slack - true) / slack
    assert abs(error.mean()) < 0.01  # without bias
    assert (low <= true + 1e-6).mean() > 0.94


def brute(x, k):
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("kind, target, block", [("flat", 4096, 4096), ("flat", 150, 4096), ("groups", 30, 20)])
def test_recall(spark, monkeypatch, kind, target, block):
    monkeypatch.setattr(A, "TARGET", target)
    monkeypatch.setattr(A, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 48))
    if kind == "groups":
        x += 6 * rng.standard_normal((9, 48))[rng.integers(0, 9, 900)]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k * 3, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = A.neighbours(df, 10).collect()
    d, near = brute(x, 10)
    assert len(got) == 9000
    assert np.mean([r.neighbour_id // 3 in near[r.vec_id // 3] for r in got]) > 0.97
    assert all(abs(r.distance - d[r.vec_id // 3, r.neighbour_id // 3]) < 1e-4 for r in got)


@pytest.mark.parametrize("kind", ["overlapping", "1/k", "low"])
def test_recall_where_neighbours_lie_across_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(A, "TARGET", 200)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1600, 64))
    if kind == "overlapping":
        x = 0.5 * x + rng.standard_normal((40, 64))[rng.integers(0, 40, 1600)]
    elif kind == "1/k":
        x /= np.arange(1, 65)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x = x[:, :3] @ rng.standard_normal((3, 64))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = A.neighbours(df, 10).collect()
    near = brute(x, 10)[1]
    assert len(got) == 16000
    assert np.mean([r.neighbour_id in near[r.vec_id] for r in got]) > 0.97


def test_work_on_separated_groups_grows_like_the_table():
    """Cells visited by a query, on groups far apart, for two sizes of the table."""
    rng = np.random.default_rng(4)
    visited = []
    for n in (20, 80):
        centres = 40 * rng.standard_normal((n, 32))
        cells = A.Cells(centres[: int(n**0.5)], centres, np.array([0, *np.linspace(0, n, int(n**0.5) + 1).astype(int)[1:]]))
        x = centres[rng.integers(0, n, 300)] + rng.standard_normal((300, 32))
        d = A._distances(x, cells.fine)
        visited.append((d - 9 <= 9).sum() / 300)
    assert visited[0] == visited[1] == 1


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    near = {i: set(ids[n]) for i, n in zip(ids, brute(x, 10)[1])}
    got = A.neighbours(df).collect()
    assert len(got) == 10 * len(ids)
    assert np.mean([r.neighbour_id in near[r.vec_id] for r in got]) > 0.97


def test_special_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, [1.0]), (9, []), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in A.neighbours(df, 10).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert A.neighbours(df.limit(0)).collect() == []
