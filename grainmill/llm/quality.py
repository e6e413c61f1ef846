"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from texts labelled good and one
from texts labelled bad. A document is cut into pieces of PIECE bytes (so that
the dictionary, not what a long text says of itself, does the predicting), each
piece is compressed with either dictionary, and over the whole text

    d = (bytes with bad - bytes with good) / (bytes with bad + bytes with good + SMOOTH)

is the normalised compressed-size difference (SMOOTH keeps a few bytes of
difference in a text of a few words from deciding anything). A text that repeats
itself compresses to nothing with either dictionary, so d says little of it; what it
lacks in compressed size tells, its repetition

    r = max(0, low - ln(bytes with good / bytes)),

where low is the same logarithm that all but QUANTILE of labelled good texts exceed.
A logistic curve over d and r, fitted on labelled texts that no dictionary has seen,
gives the probability that the text is good, at the labels' own rate of good
texts. A text is kept from KEEP_FROM on, well below even odds: what is lost to a
filter can't be had back.

The fit takes at most MAX_LABELLED texts of each label, those of the least
hash of doc_id, none over MAX_TRAIN_CHARS characters; this bound holds for the
fit alone, every document is scored, and scored whole.

Results for special cases:
* null, empty or blank text: d = r = 0, score null, kept = false (nothing to train on);
* ties: a score of exactly KEEP_FROM is kept; very long texts: scored whole, by pieces;
* labels: null and contradictory ones are left out, repeated ones count once;
* a label with fewer than MIN_LABELLED texts: there is no model, each text that
  isn't blank has score null and is kept;
* null doc_id and repeated rows: scored like any other row;
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import broadcast_ids

MAX_LABELLED, MAX_TRAIN_CHARS, MIN_LABELLED = 1500, 20_000, 20
PIECE, DICTIONARY, LEVEL = 2048, 32_768, 3
SMOOTH, KEEP_FROM, QUANTILE = 120, 0.25, 0.01


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    #: what r weighs, and the logarithm that it begins from
    per_repetition: float = 0.0
    low: float = -math.inf

    def score(self, d: float, r: float = 0.0) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * d + self.per_repetition * r + self.intercept))))


def _compressor(dictionary: bytes):
    import zstandard as zstd

    d = zstd.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(samples)[-DICTIONARY:]


def _pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def sizes(model: Model) -> Callable[[str], tuple[int, int, int]]:
    """Bytes of a text with either dictionary, good first, and without."""
    good, bad = _compressor(model.good).compress, _compressor(model.bad).compress

    def of(text: str) -> tuple[int, int, int]:
        g = b = n = 0
        for x in _pieces(text):
            g += len(good(x))
            b += len(bad(x))
            n += len(x)
        return g, b, n

    return of


def difference(model: Model) -> Callable[[str], tuple[float, float]]:
    """d and r of a text under the model's dictionaries."""
    of = sizes(model)

    def both(text: str) -> tuple[float, float]:
        g, b, n = of(text)
        return (b - g) / (b + g + SMOOTH), max(0.0, model.low - math.log(g / n)) if g else 0.0

    return both


def _logistic(x: list[tuple[float, ...]], y: list[int], weight: list[float]) -> list[float]:
    """Weights of the columns of x, and the intercept, of greatest likelihood with a small ridge, by Newton steps."""
    import numpy as np

    scale = np.array([100.0, 1.0])
    a = np.column_stack((np.array(x) * scale, np.ones(len(x))))
    t, w, beta = np.array(y, float), np.array(weight, float), np.zeros(3)

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((w * (np.logaddexp(0, z) - t * z)).sum() + 5e-4 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (t - p)) - 1e-3 * beta
        h = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, g)
        while loss(beta + step) > loss(beta) and abs(step).max() > 1e-9:
            step /= 2
        beta = beta + step
        if abs(step).max() < 1e-8:
            break
    return [*(beta[:2] * scale).tolist(), float(beta[2])]


def fit(good: list[str], bad: list[str], good_rate: float) -> Model | None:
    """The model: dictionaries from two thirds of the texts, the curve from the rest."""
    if min(len(good), len(bad)) < MIN_LABELLED:
        return None
    train, held = [[t for k, t in enumerate(x) if k % 3] for x in (good, bad)], [x[::3] for x in (good, bad)]
    dictionaries = [_dictionary([p for t in x for p in _pieces(t)]) for x in train]
    of = sizes(Model(*dictionaries, 0, 0))
    logs = sorted(math.log(g / n) for g, _, n in map(of, held[0]) if g)
    low = logs[int(QUANTILE * len(logs))]
    d = difference(Model(*dictionaries, 0, 0, 0, low))
    x, y = [d(t) for part in held for t in part], [1] * len(held[0]) + [0] * len(held[1])
    weight = [good_rate / len(held[0])] * len(held[0]) + [(1 - good_rate) / len(held[1])] * len(held[1])
    slope, per_repetition, intercept = _logistic(x, y, [w * len(x) for w in weight])
    return Model(*dictionaries, slope, intercept, min(0.0, per_repetition), low)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on the bounded sample of labelled rows (see the module's text)."""
    own = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most")
    )
    rate = own.agg(F.avg("y")).first()[0]
    picked = [own.where(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for y in (1, 0)]
    ids = {r.doc_id: r.y for p in picked for r in p.collect()}
    rows = broadcast_ids(docs.select("doc_id", "text"), list(ids)).where(F.length("text").between(1, MAX_TRAIN_CHARS) & (F.trim("text") != ""))
    rows = sorted({(r.doc_id, r.text) for r in rows.collect()})
    texts = [[t for i, t in rows if ids[i] == y] for y in (1, 0)]
    return fit(*texts, rate) if rows else None


def judge(model: Model | None) -> Callable[[list[str | None]], list[tuple[float, float, float | None, bool]]]:
    """(d, r, score, kept) for each of some texts."""
    both = difference(model) if model else None

    def of(text: str | None) -> tuple[float, float, float | None, bool]:
        if text is None or not text.strip():
            return 0.0, 0.0, None, False
        if model is None:
            return 0.0, 0.0, None, True
        d, r = both(text)
        return d, r, (s := model.score(d, r)), s >= KEEP_FROM

    return lambda texts: [of(t) for t in texts]


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge(model)
        for batch in batches:
            d, r, s, k = zip(*j(batch.column(1).to_pylist())) if batch.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d, pa.float64()), pa.array(r, pa.float64()), pa.array(s, pa.float64()), pa.array(k, pa.bool_())], names=["doc_id", "size_difference", "repetition", "score", "kept"]
            )

    return run


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, size_difference, repetition, score, kept) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_scorer(model), "doc_id bigint, size_difference double, repetition double, score double, kept boolean")


def keeper(model: Model | None):
    """For _common.keep_rows: which texts stay."""
    return lambda: (lambda j: lambda texts: [x[3] for x in j(texts)])(judge(model))
