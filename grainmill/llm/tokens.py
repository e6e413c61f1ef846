"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Each task encodes its documents and writes one file of token ids, back to
back, with no header (uint16 where every id of the vocabulary fits, else
uint32). The rows it returns, written as a table before anything else, say
which file holds which document. Token counts of the partitions are summed up
in order, which gives each partition the number of tokens before it (its base);
a document's place in the whole store is its partition's base + its own. A
second pass writes these as uint64 beside each file: one entry for each
document and one for the end. Both kinds of file are meant to be memory-mapped.

A task that runs again, after a lost executor or as a speculative copy, writes
a file of another name; only files that the written table names belong to the
store, so half-written ones are never read.

The encoder is byte-pair encoding over the public pre-tokenisation pattern. A
text without runs of white space is cut at its single spaces first, which that
pattern does as well, so each distinct word is encoded once and then looked up.
Long runs of white space, which would overflow the library's pattern matcher,
are cut out first at the places where the pattern itself cuts. The vocabulary is
read on the driver and sent to the executors.

Results for special cases:
* null or empty text: 0 tokens;
* null doc_id and repeated rows: written like any other row;
* very long texts and runs of one character: encoded whole, to the same ids;
* an empty table gives an empty store;
* other columns are not looked at.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm._common import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that an encoder remembers before it starts anew (about 120 bytes each).
REMEMBERED = 400_000
#: A run of the pattern's white space that is cut out beforehand.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
_encoders: dict[int, Encoder] = {}


class Encoder(dict):
    """Encodes texts to the bytes of their ids; maps " word" to its bytes."""

    def __init__(self, vocabulary: str | bytes):
        import tiktoken

        lines = (vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)

    def ids(self, text: str) -> bytes:
        if len(text) < 2000 or not _LONG_SPACE.search(text):
            return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            # the last space of a run goes with what follows it
            cut = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()]) + self._run(m.group()[: cut - m.start()])
            at = cut
        return np.array(out + self.encoding.encode_ordinary(text[at:]), self.dtype).tobytes()

    def _run(self, space: str) -> list[int]:
        return self.encoding._encode_single_piece(space)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)  # the pattern joins runs of white space: not for a word by itself
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.ids(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return (self.ids(first) if first and not first[-1].isspace() else self._first(first, rest)) + b"".join(map(self.__getitem__, rest))
        except KeyError:
            return self.ids(text)

    def _first(self, first: str, rest: list[str]) -> bytes:
        if rest:
            raise KeyError(first)
        return self.ids(first)


def shipped(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The vocabulary file's bytes (about 1 MB), for all executors."""
    return spark.sparkContext.broadcast(Path(vocabulary).read_bytes())


def encoder(vocabulary: str | bytes) -> Encoder:
    """The encoder of this process for a vocabulary (its bytes or path)."""
    if isinstance(vocabulary, str):
        vocabulary = Path(vocabulary).read_bytes()
    if (key := zlib.crc32(vocabulary)) not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _open(uri: str):
    """(file system, path) of a uri; pyarrow knows local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


_ROWS = "doc_id bigint, part int, file string, first bigint, n_tokens bigint"


def _writer(out: str, vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, context = encoder(vocabulary.value), TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        system, path = _open(f"{out}/{name}")
        system.create_dir(path.rpartition("/")[0])
        at, width = 0, own.dtype.itemsize
        with system.open_output_stream(path) as sink:
            for batch in batches:
                counts = np.empty(batch.num_rows, np.int64)
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = own.encode(text) if text else b""
                    sink.write(ids)
                    counts[k] = len(ids) // width
                first = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array([name] * n, pa.string()), pa.array(first), pa.array(counts)], names=["doc_id", "part", "file", "first", "n_tokens"])

    return run


def _offsets(out: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("n_tokens", "ascending")])
        start = table.column("token_start").to_numpy()
        end = start[-1:] + table.column("n_tokens").to_numpy()[-1:]
        system, path = _open(f"{out}/{table.column('file')[0].as_py()[:-4]}.idx")
        with system.open_output_stream(path) as sink:
            sink.write(np.concatenate((start, end)).astype("<u8").tobytes())
        return table

    return run


def write_tokens(docs: DataFrame, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the store to the folder `out` (a path or uri that all executors
    share) and returns (doc_id, part, file, first, n_tokens, token_start):
    document's partition, file, place in it, length and place in the store.
    The ids are written by this call, the offsets as the result is computed."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialise(docs.mapInArrow(_writer(out, shipped(docs.sparkSession, vocabulary)), _ROWS), "tokens")
    # one row a partition: a few MB even for a million partitions
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("own")).select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    placed = rows.join(bases, "part").select("doc_id", "part", "file", "first", "n_tokens", (F.col("base") + F.col("first")).alias("token_start"))
    return placed.groupBy("part").applyInArrow(_offsets(out), f"{_ROWS}, token_start bigint")


class TokenStore:
    """A written store, memory-mapped; names: the files of the store (column file)."""

    def __init__(self, folder: str, names: list[str], dtype: str = "uint16"):
        root = Path(folder.removeprefix("file://"))
        self.parts = []
        for name in sorted(set(names)):
            p = root / name
            ids = np.memmap(p, dtype, "r") if p.stat().st_size else np.zeros(0, dtype)
            self.parts.append((ids, np.memmap(p.with_suffix(".idx"), "<u8", "r")))

    def __len__(self) -> int:
        return sum(len(o) - 1 for _, o in self.parts)

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of the k-th document, counted through the partitions."""
        for ids, offsets in self.parts:
            if k < len(offsets) - 1:
                return ids[int(offsets[k] - offsets[0]) : int(offsets[k + 1] - offsets[0])]
            k -= len(offsets) - 1
        raise IndexError(k)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from the place `start` of the whole store on."""
        got = []
        for ids, offsets in self.parts:
            a, b = max(start, int(offsets[0])), min(start + n, int(offsets[-1]))
            if a < b:
                got.append(ids[a - int(offsets[0]) : b - int(offsets[0])])
        return np.concatenate(got) if got else np.zeros(0)
