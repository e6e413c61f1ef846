"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and documents are compared in lower case with single spaces.
An item is cut into segments of SEGMENT characters (about 13 words), half
overlapping (the last one ends with the item); an item no longer than that is
one segment. A document leaks an item if it holds a stretch within k edits of
one of its segments, k = EDITS of the segment's length; so a verbatim quote of
1.5 segments is always found.

Such a stretch shares at least T = m + 1 - q * (k + 1) of the m + 1 - q q-grams
of the segment, all of them within k + 1 neighbouring diagonals (document
position - segment position). So every q-gram of every document is looked up,
the hits are counted in bands of 2 (k + 1) diagonals that overlap by half, and
only regions of a band that reaches T are verified, by banded alignment. The
filter loses nothing; k is lowered for short segments so that T >= 1. Equal
segments of many items (a common prompt) are one segment in the index, and hits
are expanded in pieces of at most about PIECE, so memory is bounded whatever the
items share.

q-grams are those of characters folded to a byte, eight of which make one
machine word; equal characters fold to equal bytes, so folding only adds
candidates, and the alignment compares the characters themselves.

The index of the benchmark is broadcast in slices of at most about SLICE
characters, each with its own pass over the documents: a benchmark of any size
fits, and one of usual size is one slice.

Results for special cases:
* null or blank text or item: nothing to match, no leak;
* an item of fewer than LEAST characters ("yes", "be"): no evidence of a leak
  wherever it occurs, so it is left out; short_items() lists them;
* very long texts: searched whole, by pieces that overlap;
* ties: the least edits, then the first place, of all segments of an item;
* repeated items and documents: each row is judged, equal result rows appear once;
* null item_id: still counts for the pipeline's filter, with a null in the result;
* a null doc_id can't be named in the result (the pipeline's filter does judge it);
* an empty benchmark or table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import keep_heap

Q, SEGMENT, EDITS = 8, 80, 0.1
#: The shortest item whose occurrence is evidence, in characters.
LEAST = 20
#: Characters of the benchmark in one broadcast (about 60 MB of index), and of
#: documents that are searched at a time (one, if it is longer).
SLICE, TOGETHER = 1_000_000, 500_000
#: Hits (a q-gram of the texts at a place of a segment) that are counted at a time, 40 bytes each.
PIECE = 1_000_000
_HASH, _BITS = np.uint64(0x9E3779B97F4A7C15), 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def fold(text: str) -> np.ndarray:
    """A byte for each character."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return ((c ^ (c >> np.uint32(8)) * np.uint32(0x9D)) & np.uint32(0xFF)).astype(np.uint8)


def grams(b: np.ndarray) -> np.ndarray:
    """Each run of eight bytes as one word (a view)."""
    return np.ndarray((max(0, len(b) - Q + 1),), np.uint64, b, strides=(1,)) if len(b) >= Q else np.zeros(0, np.uint64)


class Index:
    """Segments of some benchmark items, and where each q-gram occurs in them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        own: dict[str, dict[int | None, bool]] = {}
        for item, text in sorted({(i, normal(t)) for i, t in items}, key=lambda x: (x[0] is None, x[0], x[1])):
            if len(text) >= LEAST:
                for s in {*range(0, len(text) - SEGMENT, SEGMENT // 2), max(0, len(text) - SEGMENT)}:
                    own.setdefault(text[s : s + SEGMENT], {})[item] = True
        #: (items that hold it, segment)
        self.segments: list[tuple[tuple[int | None, ...], str]] = [(tuple(i), s) for s, i in own.items()]
        length = np.array([len(s) for _, s in self.segments], np.int64)
        self.k = np.minimum((length * EDITS).astype(np.int64), length // Q - 1)
        self.need = length + 1 - Q * (self.k + 1)
        each = [grams(np.ascontiguousarray(fold(s))) for _, s in self.segments]
        all_ = np.concatenate(each) if each else np.zeros(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        self.gram, first = np.unique(all_[order], return_index=True)
        self.bounds = np.append(first, len(all_))
        self.seg = np.repeat(np.arange(len(each), dtype=np.int32), [len(e) for e in each])[order] if each else np.zeros(0, np.int32)
        self.at = np.concatenate([np.arange(len(e), dtype=np.int32) for e in each])[order] if each else np.zeros(0, np.int32)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.gram * _HASH) >> np.uint64(64 - _BITS)] = True

    def candidates(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and band starts (a diagonal) that reach the lemma's count in b."""
        g = grams(b)
        at = np.flatnonzero(self.table[(g * _HASH) >> np.uint64(64 - _BITS)])
        x = g[at]
        slot = np.minimum(np.searchsorted(self.gram, x), max(0, len(self.gram) - 1))
        same = self.gram[slot] == x
        at, slot = at[same], slot[same]
        n = self.bounds[slot + 1] - self.bounds[slot]
        total, found, i = np.cumsum(n), [], 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PIECE, "right")))
            # the next piece begins early enough to hold each stretch that this one cuts
            if j < len(at):
                j = max(j, int(np.searchsorted(at, at[i] + 4 * SEGMENT)))
            found.append(self._bands(at[i:j], slot[i:j], n[i:j]))
            if j >= len(at):
                break
            i = max(i + 1, int(np.searchsorted(at, at[j - 1] - 2 * SEGMENT)))
        hit = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        seg = hit >> 36
        return seg, (hit & ((1 << 36) - 1)) * (self.k[seg] + 1) - SEGMENT

    def _bands(self, at: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Keys (segment, band) that reach the count among the q-grams at some places."""
        begin = np.cumsum(n) - n
        post = np.arange(int(n.sum())) - np.repeat(begin - self.bounds[slot], n)
        seg = self.seg[post].astype(np.int64)
        width = self.k[seg] + 1
        band = (np.repeat(at, n) - self.at[post] + SEGMENT) // width
        key, count = np.unique(seg << 36 | band, return_counts=True)
        # bands overlap by half: each takes two neighbouring cells of width k + 1
        after = np.searchsorted(key, key + 1)
        both = count + np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), count[np.minimum(after, len(key) - 1)], 0) if len(key) else count
        low = key[both >= self.need[key >> 36]] if len(key) else key
        alone = key[count >= self.need[key >> 36]] if len(key) else key
        return np.union1d(low, alone)


def align(segment: str, region: str, k: int) -> tuple[int, int] | None:
    """(edits, end in region) of the stretch of region nearest to segment, if within k."""
    return align_many([segment], [region], k)[0]


def align_many(segments: list[str], regions: list[str], k: int) -> list[tuple[int, int] | None]:
    """align() of pairs whose segments are of equal length, all at once.

    A step for each character of the segments; a row holds a pair's band: the
    diagonals of its region, k more at either edge; begin and end in the region are
    free. Pairs that exceed k on all diagonals are dropped on the way."""
    out: list[tuple[int, int] | None] = []
    for s, r in zip(segments, regions):
        out.append((0, i + len(s)) if (i := r.find(s)) >= 0 else None)
    todo = np.array([x for x, done in enumerate(out) if done is None], np.int64)
    if not len(todo):
        return out
    code = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)
    m, wide = len(segments[0]), max(len(regions[x]) for x in todo) + 2 * k  # a stretch may begin or end with edits beyond the region
    p, t = np.stack([code(segments[x]) for x in todo]), np.full((len(todo), max(wide, m)), -1, np.int32)
    for row, x in zip(t, todo):
        row[k : k + len(regions[x])] = code(regions[x])
    n = t.shape[1] - m + 1
    step, row = np.arange(n, dtype=np.int16), np.zeros((len(todo), n), np.int16)
    for i in range(m):
        best = row + (t[:, i : i + n] != p[:, i, None])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        best -= step
        row = np.minimum.accumulate(best, axis=1)
        row += step
        if i % 12 == 11 and not (live := (row <= k).any(axis=1)).all():
            todo, p, t, row = todo[live], p[live], t[live], row[live]
            if not len(todo):
                return out
    for x, r in zip(todo.tolist(), row):
        end = int(r.argmin())
        if r[end] <= k:
            out[x] = int(r[end]), min(max(m + end - k, 0), len(regions[x]))
    return out


def search(index: Index, texts: list[str]) -> Iterator[tuple[int, int | None, int, int]]:
    """(text number, item, edits, end) of the best region for each leaked item; texts are normal."""
    starts, parts, at = [], [], SEGMENT
    parts.append(np.zeros(SEGMENT, np.uint8))
    for t in texts:
        b = fold(t)
        starts.append(at)
        parts += [b, np.zeros(SEGMENT, np.uint8)]  # no band reaches from one text into the next
        at += len(b) + SEGMENT
    best: dict[tuple[int, int | None], tuple[int, int]] = {}
    if index.segments and texts:
        begin = np.array(starts)
        seg, diagonal = index.candidates(np.concatenate(parts))
        regions = defaultdict(list)
        doc = np.maximum(np.searchsorted(begin, diagonal + SEGMENT // 2, "right") - 1, 0)
        for s, d, low in zip(seg.tolist(), doc.tolist(), diagonal.tolist()):
            regions[d, s].append(low)
            # a band beside a text's edge may belong to its neighbour
            for other in (d - 1, d + 1):
                if 0 <= other < len(texts) and starts[other] - SEGMENT <= low + 2 * SEGMENT and low <= starts[other] + len(texts[other]):
                    regions[other, s].append(low)
        tasks = defaultdict(list)
        for (d, s), lows in regions.items():
            segment, k = index.segments[s][1], int(index.k[s])
            for low in sorted(set(lows)):
                a = max(0, low - starts[d] - k)
                region = texts[d][a : max(0, low - starts[d] + 2 * (k + 1) + len(segment) + k)]
                if len(region) + k >= len(segment):
                    tasks[len(segment)].append((d, s, a, region))
        for own in tasks.values():
            for x in range(0, len(own), 512):
                part = own[x : x + 512]
                for (d, s, a, _), found in zip(part, align_many([index.segments[s][1] for _, s, _, _ in part], [r for *_, r in part], int(index.k[part[0][1]]))):
                    if found:
                        for item in index.segments[s][0]:
                            best[d, item] = min(best.get((d, item), (1 << 30, 0)), (found[0], a + found[1]))
    for (d, item), (edits, end) in best.items():
        yield d, item, edits, end


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield begin, k
            begin, size = k, 0
        size += len(t) + SEGMENT
    if begin < len(texts):
        yield begin, len(texts)


def _found(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int | None, int, int]]:
    own = [normal(t) for t in texts]
    for i, j in runs(own):
        for d, item, edits, end in search(index, own[i:j]):
            yield i + d, item, edits, end


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of the benchmark, of at most about SLICE characters each."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(total // SLICE)
    out = []
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        out.append(sc.broadcast(Index([(r.item_id, r.text) for r in own.collect()])))
    return out


def short_items(benchmark: DataFrame) -> DataFrame:
    """The items that are too short to be searched for (see LEAST)."""
    text = F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")
    return benchmark.where((text != "") & (F.length(text) < LEAST))


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = sorted({(ids[d], item, edits, end) for d, item, edits, end in _found(index.value, batch.column(1).to_pylist())}, key=str)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], (pa.int64(), pa.int64(), pa.int32(), pa.int64())[k]) for k in range(4)], names=["doc_id", "item_id", "edits", "ends_at"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, ends_at): each benchmark item that a document
    leaks, the edits of its nearest segment and where that ends in the text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for index in indexes(benchmark):
        part = docs.mapInArrow(_finder(index), "doc_id bigint, item_id bigint, edits int, ends_at bigint")
        out = part if out is None else out.union(part)
    return out.distinct()


def keeper(index):
    """For _common.keep_rows: texts without a leak stay."""

    def make():
        keep_heap()

        def keep(texts: list[str | None]) -> list[bool]:
            bad = {d for d, *_ in _found(index.value, texts)}
            return [k not in bad for k in range(len(texts))]

        return keep

    return make
