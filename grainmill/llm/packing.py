"""Best-fit packing of documents into bins of fixed capacity, by residual rounds.

A document's length is its number of UTF-8 bytes and one end mark (byte-level
tokens), or a column that holds another count, such as a tokenizer's. A document longer than the
capacity is cut: its full pieces fill bins of their own, the rest is an item.

Each partition packs its items best-fit in decreasing order: an item goes to
the open bin with the least room that holds it. Bins filled to FULL of the
capacity are emitted; the others go on as items of their own size. Before each
round the least item left anywhere is looked up, and bins with no room for it are
emitted too: nothing can be added to them. Round by round, FAN_IN partitions
merge into one and pack the rest again, until one partition is left, whose bins
are emitted whatever their fill. Only lengths and ids move, never texts, as
arrays of 48 bytes a piece.

Rounds are written to the shared folder, so a lost executor costs one task.

Results for special cases:
* null text: length of the end mark alone, like an empty text; a null in a
  length column, or a negative number, counts as 0 and takes a bin's room of 0;
* null doc_id: packed like any other, under a null id; copy numbers have gaps;
* very long texts: cut at each multiple of the capacity;
* repeated rows: each is an item; copy numbers them within their doc_id;
* ties: items of equal length in the order of doc_id, piece and copy;
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import materialise

CAPACITY, FULL, FAN_IN = 32_768, 0.98, 8
#: Rows of documents (ids and lengths, 40 bytes each) in a partition of the first round.
PER_PARTITION = 250_000
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_start", pa.int64())])
_PIECE_DDL = "struct<doc_id: bigint, piece: bigint, copy: bigint, start: bigint, length: bigint, bin_start: bigint>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; sizes descend and none exceeds the capacity."""
    rooms: list[int] = []  # distinct rooms of the open bins, ascending
    open_: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, own = capacity, len(bins)
            bins.append([i])
        else:
            room = rooms[at]
            own = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            bins[own].append(i)
        room -= size
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(own)
    return bins


def _batch(lengths: np.ndarray, pieces: pa.StructArray, filled: np.ndarray, emitted: np.ndarray) -> pa.RecordBatch:
    """Bins of so many pieces each, one behind the other."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.ListArray.from_arrays(offsets, pieces), pa.array(emitted, pa.bool_())], names=["filled", "pieces", "emitted"])


def _struct(ids: pa.Array, *others: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([ids, *(pa.array(x, pa.int64()) for x in others)], fields=list(_PIECE))


def _first(capacity: int, full: float, parts: int):
    """Cuts documents (doc_id, length) into pieces and packs those of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = pa.Table.from_batches(batches, _ROWS)
        if not own.num_rows:
            return
        own = own.sort_by([("doc_id", "ascending"), ("length", "ascending")]).combine_chunks()
        ids, n = own.column("doc_id").combine_chunks(), own.column("length").to_numpy()
        plain = ids.fill_null(0).to_numpy()
        new = np.concatenate(([True], plain[1:] != plain[:-1]))
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= nulls[1:] != nulls[:-1]
        at = np.arange(len(n))
        copy = at - np.maximum.accumulate(np.where(new, at, 0))
        copy = np.where(nulls, copy * parts + TaskContext.get().partitionId(), copy)  # null ids are in several partitions
        cut = np.maximum(0, n - 1) // capacity
        if whole := int(cut.sum()):
            of = np.repeat(at, cut)
            piece = np.arange(whole) - np.repeat(np.cumsum(cut) - cut, cut)
            full_bins = _struct(ids.take(pa.array(of)), piece, copy[of], piece * capacity, np.full(whole, capacity), np.zeros(whole, np.int64))
            yield _batch(np.ones(whole, np.int64), full_bins, np.full(whole, capacity), np.ones(whole, bool))
        rest = n - cut * capacity
        yield from _pack(np.ones(len(n), np.int64), _struct(ids, cut, copy, cut * capacity, rest, np.zeros(len(n), np.int64)), rest, capacity, full)

    return run


def _pack(lengths: np.ndarray, pieces: pa.StructArray, filled: np.ndarray, capacity: int, full: float) -> Iterator[pa.RecordBatch]:
    """Packs items, each of so many pieces and filled so far, into bins."""
    if not len(filled):
        return
    start = np.cumsum(lengths) - lengths
    field = lambda k: pieces.field(k).take(pa.array(start))
    order = pa.table({"a": -filled, "b": field("doc_id"), "c": field("piece"), "d": field("copy")})
    order = pc.sort_indices(order, [(k, "ascending") for k in "abcd"]).to_numpy()
    made = best_fit(filled[order].tolist(), capacity)
    items = order[np.fromiter(chain.from_iterable(made), np.int64, len(filled))]
    per_bin = np.fromiter(map(len, made), np.int64, len(made))
    count = lengths[items]  # pieces of each item, in the order of the bins
    take = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[items], count)
    pieces = pieces.take(pa.array(take))
    long = pieces.field("length").to_numpy(zero_copy_only=False)
    first = np.cumsum(per_bin) - per_bin
    bin_pieces = np.add.reduceat(count, first)
    at = np.cumsum(long) - long
    begin = np.cumsum(bin_pieces) - bin_pieces
    at -= np.repeat(at[begin], bin_pieces)
    size = np.add.reduceat(filled[items], first)
    pieces = pa.StructArray.from_arrays([*(pieces.field(k) for k in range(5)), pa.array(at, pa.int64())], fields=list(_PIECE))
    for k in range(0, len(size), 50_000):
        n, a = slice(k, k + 50_000), int(begin[k])
        yield _batch(bin_pieces[n], pieces.slice(a, int(bin_pieces[n].sum())), size[n], size[n] >= full * capacity)


def _again(capacity: int, full: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(batches, _BINS)
        if own.num_rows:
            pieces = own.column("pieces").combine_chunks()
            flat = pieces.flatten()
            yield from _pack(pieces.value_lengths().to_numpy().astype(np.int64), flat, own.column("filled").to_numpy(), capacity, full)

    return run


_ROWS = pa.schema([("doc_id", pa.int64()), ("length", pa.int64())])
_BINS = pa.schema([("filled", pa.int64()), ("pieces", pa.list_(_PIECE))])
_OUT = f"filled bigint, pieces array<{_PIECE_DDL}>, emitted boolean"


def bins(docs: DataFrame, capacity: int = CAPACITY, length_col: str | None = None, full: float = FULL) -> DataFrame:
    """(filled, pieces): one row for each bin."""
    spark = docs.sparkSession
    length = F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0)) if length_col else F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    items = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), length.alias("length")), "lengths")
    parts = max(1, -(-items.count() // PER_PARTITION), min(FAN_IN, spark.sparkContext.defaultParallelism))
    # equal ids meet in one partition, which numbers their copies; null ids go by their length
    by = F.coalesce(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("length"))), F.lit(0))
    made = materialise(items.repartition(parts, by).mapInArrow(_first(capacity, full, parts), _OUT), "bins")
    done = made.where("emitted")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rest = made.where("not emitted")
        # a bin that the least item left can't go into, nor the other way round, is done
        least = [r.filled for r in rest.select("filled").orderBy("filled").limit(2).collect()]
        room = capacity - (least[0] if least else 0)
        done = done.union(rest.where(F.col("filled") > room))
        if len(least) < 2 or sum(least) > capacity:
            return done.union(rest.where(F.col("filled") <= room)).select("filled", "pieces")
        rest = rest.where(F.col("filled") <= room).select("filled", "pieces").repartition(parts, F.xxhash64(F.col("pieces")[0]))
        made = materialise(rest.mapInArrow(_again(capacity, full), _OUT), "bins")
        done = done.union(made.where("emitted"))
    return done.union(made.where("not emitted")).select("filled", "pieces")


def pack(docs: DataFrame, capacity: int = CAPACITY, length_col: str | None = None, full: float = FULL) -> DataFrame:
    """(bin_id, slot, bin_start, doc_id, piece, copy, start, length, filled): where
    each piece of each document goes. bin_id names the bin's first piece."""
    b = bins(docs, capacity, length_col, full)
    first = F.col("pieces")[0]
    name = F.concat_ws(":", F.coalesce(first.doc_id.cast("string"), F.lit("null")), first.piece, first.copy)
    own = b.select(name.alias("bin_id"), "filled", F.posexplode("pieces").alias("slot", "p"))
    return own.select("bin_id", "slot", "p.bin_start", "p.doc_id", "p.piece", "p.copy", "p.start", "p.length", "filled")
