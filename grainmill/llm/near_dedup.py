"""MinHash near-duplicate removal by BagMinHash.

A document is the multiset of its word bigrams (lower case, split at white
space; a text of one word is that word). Each distinct bigram owns Poisson
processes over an (arrival time x weight) strip, arranged by octaves of the
weight: [0,1), [1,2), [2,4), [4,8) ... The process of an octave has the
octave's width as its rate, and each of its points carries a register and a
weight coordinate. A bigram of discretised weight w owns the points below w:
whole octaves below w, and the thinned part of the octave that w falls in.
The earliest arrival in each of the registers is the signature, so two texts
agree in a register with probability sum(min) / sum(max), the weighted Jaccard
similarity (Ertl, "BagMinHash", 2018). Points later than the slowest register
can't matter, so they are never drawn: about m ln m points a text.

Registers are grouped into bands; texts that share a band are candidates.
Candidates are verified by exact multiset Jaccard of the texts themselves, and
one document stays in each connected component: the one of least doc_id.

No bucket is capped. Equal texts collapse first by a 128-bit digest. Then each
bucket's members are verified against its least member, and components are
formed; a second round verifies every pair of a shared bucket that these
components haven't joined yet. A pair left out was joined already, so the
components are those of all candidate pairs. In buckets of over HOT such texts
(a common boilerplate, say) the signatures, a byte a register, are compared for
every pair first, in tiles of TILE by TILE, at some 17 ns a pair; texts are
compared where at least as many registers agree as all but one in a million
pairs of the threshold's similarity have (five standard deviations).

Results for special cases:
* null text, and text without a word: never a duplicate, never has one;
* null doc_id: ignored, it can't be named in a result (the pipeline keeps it);
* rows that repeat a doc_id are one document, whose texts all count;
* ties: a similarity of exactly THRESHOLD counts; the least doc_id is kept;
* very long texts: taken whole, one at a time;
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm._common import by_key, keep_heap, materialise, temporary

#: A pair of similarity THRESHOLD shares a band with probability 0.94, one of 0.62 with 0.99.
BANDS, ROWS = 30, 4
THRESHOLD = 0.55
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE, _MASK = 0x100000001B3, 0xFFFFFFFFFFFFFFFF
#: Texts are taken together up to this many characters, or one if it is longer.
TOGETHER = 400_000
#: Unjoined texts of a bucket from which on signatures are compared first; texts in a tile.
HOT, TILE = 64, 8192
_pow = np.ones(1, _U)


def _mix(x: np.ndarray) -> np.ndarray:
    """Multiplication carries bits up, reversing the bytes brings them down."""
    x = (x * _GOLD).byteswap()
    x = (x * _M1).byteswap()
    return (x * _M2).byteswap() * _GOLD


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        out = np.full(max(64, 2 * n), _BASE, _U)
        out[0] = 1
        _pow = np.multiply.accumulate(out)
    return _pow


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets of word bigrams of texts, one behind the other: distinct
    hashes, ascending within a text, their counts, and where each text begins
    (with the end as the last entry). One pass of array code for all texts."""
    words = [t.lower().split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    filled = [w for w in words if w]
    begin = np.concatenate(([0], np.cumsum(np.maximum(size - 1, np.minimum(size, 1)))))
    if not filled:
        return np.zeros(0, _U), np.zeros(0, np.int64), begin
    b = np.frombuffer((" ".join(map(" ".join, filled)) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(b == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    at = np.arange(len(b), dtype=np.int32) - np.repeat(starts.astype(np.int32), ends - starts + 1)
    w = _mix(np.add.reduceat(_powers(int(at.max()) + 1)[at] * (b.astype(_U) + _U(1)), starts))
    pair = _mix(w[:-1] * _GOLD + w[1:])
    last = np.cumsum(size[size > 0]) - 1  # the last word of a text starts no bigram, unless it is the only one
    only = last[size[size > 0] == 1]
    use = np.ones(len(w), bool)
    use[last] = False
    use[only] = True
    h = np.concatenate((pair, w[-1:]))
    h[only] = w[only]
    h = h[use]
    for i, j in zip(begin[:-1].tolist(), begin[1:].tolist()):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][begin[:-1] < len(h)]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(np.concatenate((at, [len(h)]))), np.searchsorted(at, begin)


def bigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word bigrams of text, ascending, and their counts."""
    return bags([text])[:2]


def discretise(count: np.ndarray) -> np.ndarray:
    """Weights 1..8 as they are, larger ones cut to three bits behind the first."""
    _, e = np.frexp(count.astype(np.float64))
    step = np.exp2(np.maximum(e - 4, 0))
    return np.floor(count / step) * step


def signatures(elements: np.ndarray, counts: np.ndarray, begin: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Earliest arrival in each of m registers for each weighted set, as an
    array of one row a set; the row of an empty set is infinite."""
    n = len(begin) - 1
    out = np.full((n, m), np.inf)
    w, of = discretise(counts), np.repeat(np.arange(n), np.diff(begin))
    total = np.bincount(of, w, n)
    todo, slack = total > 0, 2.0
    while todo.any():
        until = np.where(todo, m / np.maximum(total, 1) * (np.log(m) + slack), 0)
        flat = np.full(n * m, np.inf)
        for j in range(64):
            low, width = (2.0 ** (j - 1), 2.0 ** (j - 1)) if j else (0.0, 1.0)
            own = np.flatnonzero((w > low) & todo[of])
            if not len(own):
                break
            d, wi = of[own], (w[own] - low) / width
            end = until[d]
            s, t, draw = _mix(elements[own] + _U((j + 1) * 0x94D049BB133111EB & _MASK)), np.zeros(len(own)), 0
            part = wi.min() < 1  # of a part of the octave, only the points below the weight count
            while len(s):
                k = max(1, min(64, 8192 // len(s)))  # draws at a time; the values don't depend on it
                r = _mix(s[:, None] + np.arange(draw + 1, draw + k + 1, dtype=_U) * _M1)
                high, low32 = (r.view(np.uint32).reshape(len(s), k, 2)[:, :, h] for h in (1, 0))
                gap = np.log((high + 0.5) * 2.0**-32) / -width
                gap[:, 0] += t
                t = np.cumsum(gap, axis=1)
                live = t < end[:, None]
                slot = (d * m)[:, None] + ((low32 >> np.uint32(12)).astype(np.int64) * m >> 20)
                hit = live & ((low32 & np.uint32(4095)) * 2.0**-12 < wi[:, None]) if part else live
                np.minimum.at(flat, slot[hit], t[hit])
                draw, go = draw + k, np.flatnonzero(live[:, -1])
                s, t, wi, d, end = s[go], t[go, -1], wi[go], d[go], end[go]
        flat = flat.reshape(n, m)
        full = todo & np.isfinite(flat).all(axis=1)
        out[full] = flat[full]
        todo, slack = todo & ~full, slack + 4
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each row of registers."""
    x = registers.view(_U).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=_U) * _GOLD), x.shape[:2])
    for k in range(ROWS):
        key = _mix(key * _U(0xD6E8FEB86659FD93) + x[:, :, k])
    return key.view(np.int64)


def sketches(registers: np.ndarray) -> np.ndarray:
    """A byte for each register."""
    return (_mix(registers.view(_U)) >> _U(56)).astype(np.uint8)


def agreement(threshold: float, m: int = BANDS * ROWS) -> int:
    """Registers that a pair of that similarity agrees in, less five standard deviations."""
    return max(1, int(m * threshold - 5 * (m * threshold * (1 - threshold)) ** 0.5))


def alike(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of sketches that agree in `least` places at least."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    b = np.ascontiguousarray(b.T)
    for i in range(0, len(a), 128):
        part = a[i : i + 128]
        count = np.zeros((len(part), b.shape[1]), np.uint8)
        for k in range(a.shape[1]):
            count += part[:, k, None] == b[k]
        x, y = np.nonzero(count >= least)
        found.append((x + i, y))
    return tuple(map(np.concatenate, zip(*found)))


def _likely(threshold: float):
    least = agreement(threshold)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:3])
        tile, rep, root = (table.column(c).to_numpy() for c in ("tile", "rep", "root"))
        sig = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(tile), -1)
        own, other = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        x, y = alike(sig[own], sig[other], least)
        x, y = own[x], other[y]
        use = (root[x] != root[y]) & ((rep[x] > rep[y]) if i == j else True)
        return pa.table({"a": np.maximum(rep[x], rep[y])[use], "b": np.minimum(rep[x], rep[y])[use]})

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of bigrams."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about TOGETHER characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    keep_heap()
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for part in slices(texts):
            e, c, begin = bags(texts[part])
            some = np.flatnonzero(np.diff(begin))
            registers = signatures(e, c, begin)[some]
            keys, short = band_keys(registers), [r.tobytes() for r in sketches(registers)]
            digests = [xxhash.xxh3_128_digest(texts[part.start + k].encode("utf-8", "surrogatepass")) for k in some]
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[part][some], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array(short, pa.binary())],
                names=["doc_id", "digest", "bands", "sketch"],
            )


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(a), bool)
            for part in slices(ta):
                other = list(dict.fromkeys(tb[part]))  # a leader's text comes many times in a row
                at = {t: k for k, t in enumerate(other)}
                e, c, begin = bags(ta[part])
                e2, c2, begin2 = bags(other)
                for k in range(part.stop - part.start):
                    x, y = slice(begin[k], begin[k + 1]), slice(begin2[i := at[tb[part.start + k]]], begin2[i + 1])
                    keep[part.start + k] = overlap((e[x], c[x]), (e2[y], c2[y])) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts overlap by the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verifier(threshold), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the connected component.

    Alternating large-star and small-star passes (Kiveris et al. 2014), each
    two shuffles of the edges and written to the shared folder; the number of
    passes grows with the logarithm of the longest chain."""
    now, was = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = state
        both = now.union(now.select("b", "a"))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = F.min("b").over(Window.partitionBy("a"))
        small = large.where("a != b").withColumn("m", least)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialise(small.where("a != b").distinct(), "edges")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) for each document that another of lesser doc_id stands
    for; a kept document has no row. See the module's text for special cases."""
    with temporary(docs.sparkSession):
        return _near_duplicates(docs, threshold, id_col, text_col)


def _near_duplicates(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    marks = materialise(docs.mapInArrow(_signatures, "doc_id bigint, digest binary, bands array<bigint>, sketch binary"), "marks")
    texts_of = marks.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    # only bands that two texts share; the least member of each comes along
    in_band = Window.partitionBy("band")
    shared = (
        texts_of.select("rep", F.explode("bands").alias("band"))
        .select("rep", "band", F.min("rep").over(in_band).alias("least"), F.max("rep").over(in_band).alias("most"))
        .where("least != most")
        .select("band", "rep", "least")
    )
    shared = materialise(shared, "bands")
    exact = marks.select("doc_id", "digest").join(texts_of.select("digest", "rep"), "digest").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    texts = materialise(by_key(docs, materialise(shared.select("rep").distinct(), "ids"), "doc_id", "left_semi"), "texts")
    star = shared.where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    star = materialise(star, "star")
    first = materialise(_verified(star, texts, threshold), "verified")
    roots = components(first)
    member = shared.join(roots, shared.rep == roots.node, "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    open_bands = member.select("*", F.min("root").over(in_band).alias("lo"), F.max("root").over(in_band).alias("hi"), F.count("*").over(in_band).alias("n")).where("lo != hi")
    open_bands = materialise(open_bands.select("band", "rep", "root", "n"), "open")
    few = open_bands.where(F.col("n") <= HOT)
    x, y = few.select("band", "rep", "root").toDF("band", "a", "ra"), few.select("band", "rep", "root").toDF("band", "b", "rb")
    rest = x.join(y, "band").where("a > b and ra != rb").select("a", "b")
    many = open_bands.where(F.col("n") > HOT).join(marks.select(F.col("doc_id").alias("rep"), "sketch").distinct(), "rep")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    many = many.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = many.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "root", "sketch")
    likely = tiled.groupBy("band", "i", "j").applyInArrow(_likely(threshold), "a bigint, b bigint")
    rest = rest.union(likely).distinct().join(star, ["a", "b"], "left_anti")
    second = _verified(rest, texts, threshold)
    found = components(first.union(second).union(exact)).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))
    return materialise(found, "duplicates", keep=True)
