"""Re-balancing a corpus: proportional fitting, sampling, top-up.

A weight starts uniform and every update multiplies whole categories, so it is a
function of the cell (source, category, domain, language, token_bin). The corpus
is aggregated to its cells once; iterations run over the cells on the driver (as
many as there are combinations of categories, not rows), and the weights come
back to the rows by a broadcast join on the cell, behind a check of their number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import uniform
from grainmill.operators.distributions import DIMENSIONS, distributions, with_bin

Ratios = Mapping[str, Mapping[str, float]]
#: Cells that are fitted on the driver; more than that means a dimension is a
#: key, and fit() refuses rather than collecting it.
MAX_CELLS = 2_000_000
#: Cells whose weights are broadcast; more of them are joined by shuffle.
BROADCAST_CELLS = 200_000


def cells(meta: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dims, tokens, n): one row for each combination that occurs."""
    return with_bin(meta).groupBy(*dims).agg(F.sum("token_count").alias("tokens"), F.count("*").alias("n"))


@dataclass
class Feasibility:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def feasibility(shares: Mapping[str, Mapping[str, float]], ratios: Ratios, priority: Sequence[str] | None = None) -> Feasibility:
    """Whether targets can be met: categories exist, each dimension sums to 1
    within 1 %, priority lists the same dimensions. A target over 1.05 times
    the present share is only warned of."""
    out = Feasibility()
    for dim, own in ratios.items():
        for value, target in own.items():
            have = shares.get(dim, {}).get(value)
            if have is None:
                out.errors.append(f"{dim}: no rows of {value!r}")
            elif target > 1.05 * have:
                out.warnings.append(f"{dim}={value}: target {target:.4f} over present share {have:.4f}")
        if not 0.99 <= sum(own.values()) <= 1.01:
            out.errors.append(f"{dim}: targets sum to {sum(own.values()):.4f}")
    if priority is not None and set(priority) != set(ratios):
        out.errors.append("priority and targets name different dimensions")
    return out


@dataclass
class Fit:
    cells: list[dict]
    weights: np.ndarray
    errors: dict[str, float]
    iterations: int
    ok: bool


def _groups(rows: list[dict], ratios: Ratios, order: Sequence[str]) -> list[tuple[str, list[tuple[np.ndarray, float]]]]:
    return [(d, [(np.array([r[d] == v for r in rows]), float(t)) for v, t in ratios[d].items()]) for d in order]


def _errors(w: np.ndarray, t: np.ndarray, groups) -> dict[str, float]:
    total = float(w @ t)
    return {d: max((abs(float(w[m] @ t[m]) / total - x) for m, x in own), default=0.0) if total else 0.0 for d, own in groups}


def solve(rows: list[dict], ratios: Ratios, total: float, variant: str = "priority", priority: Sequence[str] | None = None, iterations: int | None = None, tolerance: float | None = None) -> Fit:
    """Fits weights of cells so that each dimension's token shares meet its targets.

    variant:
    * "plain": a category's factor is target / share, the total recomputed for
      each category, a target of 0 empties it; 50 iterations, 1 %;
    * "frozen": factor within [0.5, 2], none for a target of 0, a dimension once
      within tolerance is left alone; 100 iterations, 0.5 %;
    * "accumulated": as frozen, but every dimension is fitted until each has
      been within tolerance at some iteration;
    * "chunked": as accumulated, with plain's 50 iterations and 1 %, and no stop for
      small changes: for corpora that are read in chunks, whose cells add up;
    * "priority": the shares of a sweep refer to the total at its beginning,
      factor within [0.7, 1.4] times a total factor within [0.8, 1.25 capped at
      1.2], dimensions in the order given; 100 iterations, 0.5 %.
    All but the first measure success after the weights are scaled to `total`."""
    plain, stale, chunked = variant == "plain", variant == "priority", variant == "chunked"
    iterations = iterations or (50 if plain or chunked else 100)
    tolerance = tolerance or (0.01 if plain or chunked else 0.005)
    t = np.array([float(r["tokens"] or 0) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    groups = _groups(rows, ratios, priority or list(ratios))
    w = np.full(len(rows), total / t.sum() if stale and t.sum() else 1.0)
    still = 1e-4 if plain else 1e-5
    met: set[str] = set()
    last: dict[str, float] = {}
    done = 0
    for done in range(1, iterations + 1):
        before, last = w.copy(), {}
        whole = float(w @ t)
        pull = min(max(total / whole, 0.8), 1.2) if stale and whole else 1.0
        for d, own in groups:
            if variant == "frozen" and d in met:
                last[d] = 0.0
                continue
            worst = 0.0
            for m, target in own:
                base = whole if stale else float(w @ t)
                share = float(w[m] @ t[m]) / base if base else 0.0
                worst = max(worst, abs(share - target))
                if share <= 1e-5 or (not plain and target <= 0):
                    continue
                if plain:
                    w[m] *= target / share
                elif stale:
                    w[m] *= min(max(target / share, 0.7), 1.4) * pull
                else:
                    w[m] *= min(max(target / (share + (1e-8 if variant in ("accumulated", "chunked") else 0)), 0.5), 2.0)
            last[d] = worst
            if worst < tolerance:
                met.add(d)
        close = len(met) == len(groups) if variant in ("accumulated", "chunked") else all(e < tolerance for e in last.values())
        change = float((n * np.abs(w - before) / (before + 1e-5)).sum() / n.sum()) if n.sum() else 0.0
        if close or (change < still and not chunked):
            break
    if w @ t:
        w = w * (total / float(w @ t))
    errors = last if plain else _errors(w, t, groups)
    return Fit(rows, w, errors, done, all(e < tolerance if plain else e <= tolerance for e in errors.values()))


def fit(meta: DataFrame, ratios: Ratios, total: float, priority: Sequence[str] | None = None, variant: str = "priority", **how) -> Fit:
    """solve() on the cells of meta."""
    table = cells(meta, list(ratios)).where(" and ".join(f"{d} is not null" for d in ratios))
    rows = [r.asDict() for r in table.limit(MAX_CELLS + 1).collect()]
    if len(rows) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} combinations of {list(ratios)}: one of them is no dimension")
    rows.sort(key=lambda r: tuple(str(r[d]) for d in ratios))
    return solve(rows, ratios, total, variant, priority, **how)


def weighted(meta: DataFrame, f: Fit, dims: Sequence[str]) -> DataFrame:
    """meta with its column `weight`; rows of no cell (a null value) get 0."""
    spark = meta.sparkSession
    own = spark.createDataFrame([(*[c[d] for d in dims], float(w)) for c, w in zip(f.cells, f.weights)], ", ".join(f"{d} string" for d in dims) + ", weight double")
    own = F.broadcast(own) if len(f.cells) <= BROADCAST_CELLS else own
    return with_bin(meta).join(own, list(dims), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sample(rows: DataFrame, total: float, key: str, seed: int = 0, top_up: str = "level") -> DataFrame:
    """Keeps a row with probability weight (at most 1). If under 95 % of `total`
    tokens come together, rows not taken are drawn again: "level" each with
    missing / remaining tokens, so the expectation meets the target; "steep"
    with that times the row's tokens, which takes nearly all; "none" not at all."""
    marked = rows.withColumn("__u", uniform(F.col(key), seed)).withColumn("__in", F.col("__u") < F.least("weight", F.lit(1.0)))
    if top_up != "none":
        got, rest = marked.agg(F.sum(F.when(F.col("__in"), F.col("token_count"))), F.sum(F.when(~F.col("__in"), F.col("token_count")))).first()
        missing = total - float(got or 0)
        if float(got or 0) < 0.95 * total and rest:
            p = F.lit(missing / float(rest)) * (F.col("token_count") if top_up == "steep" else F.lit(1.0))
            again = (uniform(F.col(key), seed + 1) < F.least(p, F.lit(1.0))) & (F.col("token_count") > 0)
            marked = marked.withColumn("__in", F.col("__in") | again)
    return marked.where("__in").drop("__u", "__in")


def factors(shares: Mapping[str, Mapping[str, float]], ratios: Ratios) -> dict[str, dict[str, float]]:
    """One-pass weights: target / (row share + 1e-8) within [0.1, 10]; 0 where the share is 0."""
    return {d: {v: min(max(x / (shares[d][v] + 1e-8), 0.1), 10.0) if shares.get(d, {}).get(v) else 0.0 for v, x in own.items()} for d, own in ratios.items()}


def row_probability(meta: DataFrame, weights: Ratios) -> DataFrame:
    """meta with `probability`: the product of its values' weights, 1 for a value
    without one, within [0, 1]."""
    p = F.lit(1.0)
    for d, own in weights.items():
        table = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
        p = p * F.coalesce(F.try_element_at(table, F.col(d)), F.lit(1.0))
    return with_bin(meta).withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def sweep(table: DataFrame, ratios: Ratios, total: float, priority: Sequence[str]) -> DataFrame:
    """One sweep of the "priority" variant as a plan over cells: (dims, tokens, n, weight)."""
    from pyspark.sql import Window

    whole = Window.partitionBy()
    out = table.withColumn("weight", F.lit(float(total)) / F.sum("tokens").over(whole))
    out = out.withColumn("base", F.sum(F.col("weight") * F.col("tokens")).over(whole))
    pull = F.least(F.greatest(F.lit(float(total)) / F.col("base"), F.lit(0.8)), F.lit(1.2))
    for d in priority:
        target = F.create_map(*[F.lit(x) for kv in ratios[d].items() for x in kv])
        out = out.withColumn("r", F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(d)) / F.col("base")).withColumn("x", F.try_element_at(target, F.col(d)))
        step = F.least(F.greatest(F.col("x") / F.col("r"), F.lit(0.7)), F.lit(1.4)) * pull
        out = out.withColumn("weight", F.col("weight") * F.when((F.col("r") > 1e-5) & (F.col("x") > 0), step).otherwise(1.0))
    return out.drop("base", "r", "x")


def shares(meta: DataFrame, dims: Sequence[str], by_rows: bool = False) -> dict[str, dict[str, float]]:
    """Present shares of a few dimensions, on the driver. Raises on more than MAX_CELLS values."""
    out: dict[str, dict[str, float]] = {d: {} for d in dims}
    rows = distributions(meta, tuple(dims)).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} values of {list(dims)}: one of them is no dimension")
    for r in rows:
        out[r.dim][r.value] = float(r.n if by_rows else r.tokens or 0)
    return {d: {v: x / (sum(own.values()) or 1) for v, x in own.items()} for d, own in out.items()}
