"""Proportional fitting and sampling against an independent restatement over rows."""

import random

import numpy as np
import pytest

from grainmill.operators import distributions as D
from grainmill.operators import mixing as M
from grainmill.plans import mix

RATIOS = {"language": {"en": 0.5, "de": 0.5}, "category": {"a": 0.2, "b": 0.3, "c": 0.5}}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, rng.choice("xyz"), rng.choices("abc", (5, 3, 2))[0], "d", rng.choices(("en", "de"), (7, 3))[0], rng.randrange(1, 40_000)) for i in range(1500)]


@pytest.fixture(scope="module")
def meta(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source string, category string, domain string, language string, token_count bigint")


def by_rows(rows, ratios, total, order, iterations=100, tolerance=0.005):
    """The priority variant over row vectors."""
    t = np.array([float(r[5]) for r in rows])
    member = {d: {v: np.array([r[{"language": 4, "category": 2}[d]] == v for r in rows]) for v in own} for d, own in ratios.items()}
    w = np.full(len(rows), total / t.sum())
    for _ in range(iterations):
        old, whole, met = w.copy(), w @ t, True
        pull = min(max(total / whole, 0.8), 1.2)
        for d in order:
            for v, x in ratios[d].items():
                m = member[d][v]
                share = w[m] @ t[m] / whole
                met &= abs(share - x) < tolerance
                if share > 1e-5 and x > 0:
                    w[m] *= min(max(x / share, 0.7), 1.4) * pull
        if met or np.mean(np.abs(w - old) / (old + 1e-5)) < 1e-5:
            break
    return w * total / (w @ t)


def test_cells_give_the_weights_of_rows(meta, rows):
    total = sum(r[5] for r in rows) * 0.3
    f = M.fit(meta, RATIOS, total, ("category", "language"))
    expected = by_rows(rows, RATIOS, total, ("category", "language"))
    own = {(c["language"], c["category"]): w for c, w in zip(f.cells, f.weights)}
    assert np.allclose([own[r[4], r[2]] for r in rows], expected, rtol=1e-9)
    assert f.ok and max(f.errors.values()) <= 0.005


@pytest.mark.parametrize("variant", ["plain", "frozen", "accumulated"])
def test_variants_meet_targets(meta, variant):
    f = M.fit(meta, RATIOS, 1e6, variant=variant, iterations=300)
    t = np.array([c["tokens"] for c in f.cells], float)
    assert abs(f.weights @ t - 1e6) < 1
    share = sum(w * x for w, x, c in zip(f.weights, t, f.cells) if c["language"] == "de") / 1e6
    assert abs(share - 0.5) < 0.03


def test_zero_target_empties_in_plain_only(meta):
    r = {"category": {"a": 0.0, "b": 0.5, "c": 0.5}}
    for variant, empty in (("plain", True), ("priority", False)):
        f = M.fit(meta, r, 1e6, variant=variant)
        assert all((w == 0) == (c["category"] == "a" and empty) for w, c in zip(f.weights, f.cells))


def test_feasibility():
    shares = {"language": {"en": 0.9, "de": 0.1}}
    assert M.feasibility(shares, {"language": {"en": 0.9, "de": 0.1}}, ["language"]).ok
    assert M.feasibility(shares, {"language": {"en": 0.5, "de": 0.5}}).warnings
    for bad in ({"language": {"en": 0.9, "xx": 0.1}}, {"language": {"en": 0.9, "de": 0.05}}):
        assert not M.feasibility(shares, bad).ok
    assert not M.feasibility(shares, {"language": {"en": 0.9, "de": 0.1}}, ["category"]).ok
    assert M.feasibility(shares, {"language": {"en": 0.9, "de": 0.11}}).ok


def test_sample_is_reproducible_and_near_target(meta, rows):
    total = sum(r[5] for r in rows) * 0.3
    a, f = mix(meta, RATIOS, total, "id", ("category", "language"), seed=3)
    b, _ = mix(meta.repartition(7), RATIOS, total, "id", ("category", "language"), seed=3)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    got = sum(r.token_count for r in a.collect())
    assert abs(got / total - 1) < 0.15
    dev = {r["dim"]: r.max_deviation for r in D.deviation(a, a, ("language",)).collect()}
    assert dev == {"language": 0.0}


def test_level_top_up_meets_the_target_and_steep_overshoots(meta, rows):
    low = M.weighted(meta, M.fit(meta, RATIOS, 1e5), list(RATIOS))
    want = sum(r[5] for r in rows) * 0.5
    level, steep = (sum(r.token_count for r in M.sample(low, want, "id", top_up=k).collect()) for k in ("level", "steep"))
    assert abs(level / want - 1) < 0.1
    assert steep > 1.8 * want


def test_one_pass_factors(spark):
    f = M.factors({"language": {"en": 0.8, "de": 0.001}}, {"language": {"en": 0.4, "de": 0.5, "fr": 0.1}})
    assert f["language"]["fr"] == 0 and f["language"]["de"] == 10 and abs(f["language"]["en"] - 0.5) < 1e-6


def test_empty_and_null(spark, meta):
    none = meta.limit(0)
    assert D.distribution(none, "language").collect() == []
    assert len(D.ordered_bins(none).collect()) == 5
    odd = spark.createDataFrame([(1, None, "a", "d", "en", None)], meta.schema)
    assert D.distribution(odd, "source").collect() == [] and M.cells(odd).count() == 1


def test_shares_refuse_a_key_as_dimension(meta, monkeypatch):
    monkeypatch.setattr(M, "MAX_CELLS", 2)
    with pytest.raises(ValueError):
        M.shares(meta, ["source", "language"])


def test_weights_come_back_alike_by_shuffle(meta, monkeypatch):
    f = M.fit(meta, RATIOS, 1e6)
    small = sorted(map(str, M.weighted(meta, f, list(RATIOS)).collect()))
    monkeypatch.setattr(M, "BROADCAST_CELLS", 0)
    assert sorted(map(str, M.weighted(meta, f, list(RATIOS)).collect())) == small
