"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is a query and the result is its K nearest others by Euclidean
distance. Vectors belong to cells, of TARGET vectors or so, found in two levels:
about sqrt(cells) coarse centroids by Lloyd steps over all vectors, then those of
the cells within each coarse one, so a vector is compared with 2 sqrt(cells)
centroids and not with all. A vector's residual from its cell's centroid is
rotated by a fixed random orthogonal matrix and kept as its signs, packed to bits,
with two scalars: its norm and the inner product of the unit residual o with its
own code x. For a query's residual q,

    <o, q>  is estimated without bias by  <x, q> / <x, o>,

with an error of at most ERROR * |q| * sqrt((1 - <x, o>^2) / (<x, o>^2 (D - 1)))
but for a small probability (Gao and Long, "RaBitQ", 2024). The scalars of a code
and the error go into two further columns beside its signs, so one matrix product
of a block of codes, unpacked for the time of use, and a block of queries gives
the lower bounds of all their distances. Only vectors whose bound doesn't exceed
the query's K-th distance so far are reranked by true distance.

Cells are written to the shared folder, a file each, and read by the tasks as they
need them; queries are taken in the order of their cells. A query searches its own
cell first, which bounds its K-th distance, then each other cell where a member may
be nearer: none is, if the cell's members lie between `least` and `most` of its
centroid and the query's distance from that is further off than its K-th distance
(triangle inequality, for coarse cells first). That holds for any data, so no cell
that holds a neighbour is skipped. Nothing is shuffled but the vectors themselves,
once to write the cells and once to order the queries. On separated data a query
visits few cells and the work grows like the table; vectors without structure, in
many dimensions, have no cells to skip and the work grows with its square, at about
24 ns a pair. Nothing is capped.

Results for special cases:
* null vectors, vectors with a null, NaN or infinite entry and vectors of
  another dimension than most: left out, neither query nor neighbour;
* null vec_id: left out; a vec_id that repeats: one row of least vector counts;
* equal vectors: distance 0; ties: the least neighbour first;
* fewer than K + 1 vectors: fewer neighbours; an empty table: an empty result;
* other columns are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import keep_heap, materialise, scratch_path

K, STEPS, TARGET = 10, 2, 1024
ERROR, SEED = 1.9, 20240527
#: Relative slack of the bounds, for rounding; queries and vectors that are compared at a time; bytes of cells that a worker remembers.
SLACK, QUERIES, BLOCK, REMEMBERED = 1e-5, 512, 4096, 256 << 20
#: Queries of a task.
PER_TASK = 2048


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the residuals (rows of x), packed, and their correction scalars."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        y = x @ turn
        self.d = x.shape[1]
        self.norm = np.linalg.norm(x, axis=1)
        self.bits = np.packbits(y >= 0, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.own = np.where(self.norm > 0, np.abs(y).sum(axis=1) / (self.norm * np.sqrt(self.d)), 1.0)


def spread(self_d: int, own: np.ndarray) -> np.ndarray:
    """The bound of the estimate's error, for unit vectors."""
    return ERROR * np.sqrt(np.maximum(0, 1 - own**2) / (own**2 * max(1, self_d - 1)))


def columns(bits: np.ndarray, norm: np.ndarray, own: np.ndarray, d: int) -> np.ndarray:
    """What, times [rotated residual of a query, 1, its norm], is the lower bound of a
    squared distance less the query's squared norm: the codes' signs and scalars."""
    out = np.empty((len(norm), d + 2), np.float32)
    out[:, :d] = np.unpackbits(bits, axis=1, count=d)
    out[:, :d] *= 2
    out[:, :d] -= 1
    out[:, :d] *= (-2 * norm / (np.sqrt(d) * own)).astype(np.float32)[:, None]
    out[:, d] = norm**2
    out[:, d + 1] = -2 * norm * spread(d, own)
    return out


@dataclass
class Cell:
    ids: np.ndarray
    x: np.ndarray
    matrix: np.ndarray

    @property
    def size(self) -> int:
        return self.x.nbytes + self.matrix.nbytes + self.ids.nbytes


class Best:
    """The k nearest so far of some queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.far = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)

    @property
    def kth(self) -> np.ndarray:
        return self.far[:, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, far: np.ndarray) -> None:
        """Neighbours ids at squared distances far of the queries q (their numbers)."""
        own = np.unique(q)
        a = np.concatenate((np.repeat(own, self.k), q))
        b, f = np.concatenate((self.near[own].ravel(), ids)), np.concatenate((self.far[own].ravel(), far))
        order = np.lexsort((b, f, a))
        a, b, f = a[order], b[order], f[order]
        top = np.searchsorted(a, own)[:, None] + np.arange(self.k)
        self.near[own], self.far[own] = b[top], f[top]


def search(cell: Cell, centre: np.ndarray, best: Best, which: np.ndarray, turn: np.ndarray, itself: bool) -> None:
    """Looks among a cell's vectors for nearer ones of the queries `which`."""
    for i in range(0, len(which), QUERIES):
        q = which[i : i + QUERIES]
        x = best.x[q]
        r = x - centre
        r2 = (r**2).sum(axis=1)
        right = np.concatenate((r @ turn, np.ones((len(q), 1)), np.sqrt(r2)[:, None]), axis=1).astype(np.float32)
        low = right @ cell.matrix.T
        if itself:
            at = np.minimum(np.searchsorted(cell.ids, best.ids[q]), len(cell.ids) - 1)
            own = np.flatnonzero(cell.ids[at] == best.ids[q])
            low[own, at[own]] = np.inf

        def distances(a: np.ndarray, b: np.ndarray, x=x) -> np.ndarray:
            far = np.empty(len(a))
            for c in range(0, len(a), 8192):  # a piece that fits the cache at a time
                apart = cell.x[b[c : c + 8192]] - x[a[c : c + 8192]]
                np.einsum("ij,ij->i", apart, apart, out=far[c : c + 8192])
            return far

        kth = best.kth[q]
        new = np.flatnonzero(kth == np.inf)
        if len(new) and low.shape[1] > 4 * best.k:
            # a first bound: the true distances of those that look nearest
            some = np.argpartition(low[new], 4 * best.k, axis=1)[:, : 4 * best.k]
            far = distances(np.repeat(new, some.shape[1]), some.ravel()).reshape(some.shape)
            far[np.take_along_axis(low[new], some, axis=1) == np.inf] = np.inf
            kth = kth.copy()
            kth[new] = np.partition(far, best.k - 1, axis=1)[:, best.k - 1]
        bound = kth - r2 + SLACK * (r2 + np.where(np.isfinite(kth), kth, 0))
        a, b = np.nonzero((low <= bound.astype(np.float32)[:, None]) & (low < np.inf))
        far = distances(a, b)
        good = far <= kth[a]
        if good.any():
            best.add(q[a[good]], cell.ids[b[good]], far[good])


def _vectors(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    v = batch.column(name)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if len(centres) == 1:
        return np.zeros(len(x), np.int64)
    centres = centres.astype(np.float64)
    square, step = (centres**2).sum(axis=1), max(1, (1 << 22) // len(centres))
    return np.concatenate([np.argmin(square - 2 * (x[i : i + step] @ centres.T), axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


@dataclass
class Cells:
    """Coarse centroids; those of the cells, one coarse one's behind the other's; where each begins."""

    coarse: np.ndarray
    fine: np.ndarray
    starts: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        s = nearest(x, self.coarse)
        out = np.empty(len(x), np.int64)
        for k in np.unique(s):
            own = np.flatnonzero(s == k)
            out[own] = self.starts[k] + nearest(x[own], self.fine[self.starts[k] : self.starts[k + 1]])
        return out


def _sums(cells: Broadcast, coarse: bool):
    """Sums and counts of vectors by coarse centroid or by cell, one row for each and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        count, d = (c.coarse if coarse else c.fine).shape
        total, n = np.zeros((count, d)), np.zeros(count, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, "v")
                own = nearest(x, c.coarse) if coarse else c.of(x)
                order = np.argsort(own, kind="stable")
                some, first = np.unique(own[order], return_index=True)
                total[some] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(own, minlength=count)
        some = np.flatnonzero(n)
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * d)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel())), pa.array(n[some])], names=["c", "total", "n"])

    return run


def _lloyd(vectors: DataFrame, cells: Cells, coarse: bool) -> np.ndarray:
    """Each centroid of a level as the mean of its vectors; one without any stays."""
    out = (cells.coarse if coarse else cells.fine).copy()
    d, sent = out.shape[1], vectors.sparkSession.sparkContext.broadcast(cells)
    sums = vectors.select("v").mapInArrow(_sums(sent, coarse), "c int, total array<double>, n bigint")
    for r in sums.groupBy("c").agg(F.array(*[F.sum(F.col("total")[k]) for k in range(d)]).alias("total"), F.sum("n").alias("n")).collect():
        out[r.c] = np.array(r.total) / r.n
    sent.destroy()
    return out


def train(vectors: DataFrame, count: int, steps: int = STEPS) -> Cells:
    """About `count` cells from vectors of least hash, after some Lloyd steps over all
    vectors on either level. The driver and each executor hold a 4-byte float a cell
    and dimension: 250 MB for a billion vectors of 64."""
    rows = vectors.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(count).select("v").collect()
    first = np.array([r.v for r in rows], np.float32)
    coarse = first[: int(np.ceil(np.sqrt(len(first))))]
    for _ in range(steps if len(coarse) > 1 else 0):
        coarse = _lloyd(vectors, Cells(coarse, coarse, np.arange(len(coarse) + 1)), True)
    of = nearest(first, coarse)
    fine = [first[of == k] if (of == k).any() else coarse[k : k + 1] for k in range(len(coarse))]
    cells = Cells(coarse, np.concatenate(fine), np.concatenate(([0], np.cumsum([len(f) for f in fine]))))
    for _ in range(steps):
        cells = Cells(coarse, _lloyd(vectors, cells, False), cells.starts)
    return cells


def _assign(sent: Broadcast):
    """Each vector's cell, its distance from that centroid and its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        turn = rotation(cells.fine.shape[1])
        for b in batches:
            x = _vectors(b, "v")
            c = cells.of(x)
            code = Codes(x - cells.fine[c], turn)
            bits = pa.array([r.tobytes() for r in code.bits], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), b.column(0), b.column(1), bits, pa.array(code.norm), pa.array(code.own)], names=["c", "vec_id", "v", "bits", "norm", "own"])

    return run


_remembered: OrderedDict[tuple[str, int], list[Cell]] = OrderedDict()


def _cell(path: str, c: int, d: int) -> Iterator[Cell]:
    """A cell's vectors, BLOCK at a time; those read last are remembered."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if (path, c) in _remembered:
        _remembered.move_to_end((path, c))
        yield from _remembered[path, c]
        return
    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    made, held = [], 0
    for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/c={c}")), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as source:
            for b in pq.ParquetFile(source).iter_batches(BLOCK, columns=["vec_id", "v", "bits", "norm", "own"]):
                bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                ids, norm, own = (b.column(k).to_numpy() for k in ("vec_id", "norm", "own"))
                cell = Cell(ids, _vectors(b, "v").astype(np.float32), columns(bits, norm, own, d))
                held += cell.size
                if held <= REMEMBERED:
                    made.append(cell)
                yield cell
    if held <= REMEMBERED:
        _remembered[path, c] = made
        while sum(x.size for own in _remembered.values() for x in own) > REMEMBERED:
            _remembered.popitem(last=False)


def _searcher(path: str, sent: Broadcast, edges: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        cells, (least, most) = sent.value, edges.value
        d = cells.fine.shape[1]
        turn = rotation(d)
        # how far from a coarse centroid its cells' members are at most
        apart = [np.linalg.norm(cells.fine[a:b] - cells.coarse[s], axis=1) for s, (a, b) in enumerate(zip(cells.starts, cells.starts[1:]))]
        reach = np.array([max((x + most[a + i] for i, x in enumerate(own) if most[a + i] >= 0), default=-np.inf) for own, a in zip(apart, cells.starts)])
        for batch in batches:
            if not batch.num_rows:
                continue
            c, best = batch.column(0).to_numpy(), Best(batch.column(1).to_numpy(), _vectors(batch, "v"), k)

            def visit(j: int, which: np.ndarray, own: bool, best=best) -> None:
                for cell in _cell(path, int(j), d):
                    search(cell, cells.fine[j], best, which, turn, own)

            for j in np.unique(c):
                visit(j, np.flatnonzero(c == j), True)

            def may(dist: np.ndarray, low: float, high: float, best=best) -> np.ndarray:
                return np.maximum(dist - high, low - dist) <= np.sqrt(best.kth) * (1 + SLACK) + SLACK * (1 + dist)

            to_coarse = _distances(best.x, cells.coarse)
            for s in np.argsort(to_coarse.mean(axis=0)):
                some = np.flatnonzero(may(to_coarse[:, s], -np.inf, reach[s]))
                if not len(some):
                    continue
                a = cells.starts[s]
                to_fine = _distances(best.x[some], cells.fine[a : cells.starts[s + 1]])
                for i in np.argsort(to_fine.min(axis=0)):
                    if most[j := a + i] >= 0:
                        full = np.full(len(c), np.inf)
                        full[some] = to_fine[:, i]
                        which = np.flatnonzero((c != j) & np.isfinite(full) & may(full, least[j], most[j]))
                        if len(which):
                            visit(j, which, False)
            n, rank = np.nonzero(np.isfinite(best.far))
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.ids[n]), pa.array((rank + 1).astype(np.int32)), pa.array(best.near[n, rank]), pa.array(np.sqrt(best.far[n, rank]))], names=["vec_id", "rank", "neighbour_id", "distance"]
            )

    return run


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    centres = centres.astype(np.float64)
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(axis=1)))


def neighbours(embeddings: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others of each vector."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<float>")
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = embeddings.where(sound & (F.size("embedding") > 0)).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(v).alias("v"))
    own = materialise(own, "vectors")
    dims = {r.d: r.n for r in own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    out = "vec_id bigint, rank int, neighbour_id bigint, distance double"
    if not dims:
        return spark.createDataFrame([], out)
    d = max(dims, key=lambda x: (dims[x], x))
    own = own.where(F.size("v") == d)
    cells = train(own, -(-dims[d] // TARGET))
    sc = spark.sparkContext
    sent = sc.broadcast(cells)
    base = own.mapInArrow(_assign(sent), "c int, vec_id bigint, v array<float>, bits binary, norm double, own double")
    path = scratch_path(spark, "cells")
    base.repartition("c").sortWithinPartitions("c", "vec_id").write.option("compression", "zstd").partitionBy("c").parquet(path)
    base = spark.read.schema("vec_id bigint, v array<float>, norm double, c int").parquet(path)
    least, most = np.zeros(len(cells.fine)), np.full(len(cells.fine), -1.0)
    for r in base.groupBy("c").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).collect():
        least[r.c], most[r.c] = r.least, r.most
    asks = base.select("c", "vec_id", "v").repartitionByRange(-(-dims[d] // PER_TASK), "c", "vec_id").sortWithinPartitions("c", "vec_id")
    return asks.mapInArrow(_searcher(path, sent, sc.broadcast((least, most)), k), out)
