"""Cleaning mappers and text statistics of the declarative recipe, as expressions.

Definitions follow the published descriptions of such operators; thresholds are
parameters with the recipe's values as defaults (see operators.recipe)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.text import let

EMAIL = r"[A-Za-z0-9.\-+_]+@[A-Za-z0-9.\-+_]+\.[A-Za-z]+"
LINK = r"(?i)\b(?:https?|ftp)://[^\s<>\"']+|\bwww\.[^\s<>\"']+"
_PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'",
    "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": "-", "．": ".", "～": "~", "’": "'", "━": "-", "〈": "<",
    "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
#: Every space separator but the plain one, and the invisible characters that stand for none.
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff\ufffc\u0084"


def clean_email(t: Column) -> Column:
    return F.regexp_replace(t, EMAIL, "")


def clean_links(t: Column) -> Column:
    return F.regexp_replace(t, LINK, "")


def normalise_punctuation(t: Column) -> Column:
    """Unicode punctuation as ASCII; an ellipsis is three dots."""
    return F.replace(F.translate(t, "".join(_PUNCTUATION), "".join(_PUNCTUATION.values())), F.lit("…"), F.lit("..."))


def normalise_whitespace(t: Column) -> Column:
    """Exotic spaces as plain ones, trimmed."""
    return F.trim(F.translate(t, _SPACES, " " * len(_SPACES)))


def _mend(text: str) -> str:
    """Undoes UTF-8 that was read as Latin-1, where that gives valid text; then NFC."""
    if any("\xc2" <= c <= "\xf4" for c in text):
        try:
            text = text.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return unicodedata.normalize("NFC", text)


def fix_unicode(t: Column) -> Column:
    """Only texts with a character beyond ASCII go to Python."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else _mend(s) for s in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    other = F.regexp_like(t, F.lit(r"[^\x00-\x7f]"))
    return F.when(other, F.arrow_udf(run, "string")(F.when(other, t))).otherwise(t)


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(0.0))


def alphanumeric_share(t: Column) -> Column:
    return _share(F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")), F.length(t))


def special_share(t: Column) -> Column:
    """Characters that are neither letters, digits nor plain space."""
    return _share(F.regexp_count(t, F.lit(r"[^\p{L}\p{N} ]")), F.length(t))


def average_line_length(t: Column) -> Column:
    return F.length(t) / F.size(F.split(t, "\n"))


def maximum_line_length(t: Column) -> Column:
    return F.array_max(F.transform(F.split(t, "\n"), F.length))


def words(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"[\s]+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def flagged_share(t: Column, flagged: Sequence[str]) -> Column:
    hits = lambda own: F.size(F.filter(own, lambda w: w.isin(*flagged))) if flagged else F.lit(0)
    return let(words(t), lambda own: _share(hits(own), F.size(own)))


def _repeated(grams: Column) -> Column:
    """The share of entries whose value occurs more than once: entries are sorted,
    and counted where a neighbour is equal."""
    same = lambda s: F.filter(s, lambda g, i: (F.get(s, i - 1) == g) | (F.get(s, i + 1) == g))
    return let(F.array_sort(grams), lambda s: _share(F.size(same(s)), F.size(s)))


def word_repetition(t: Column, n: int = 10) -> Column:
    """The share of word n-grams that occur more than once. Every word is
    hashed once; an n-gram is a hash of its words' hashes."""

    def grams(h: Column) -> Column:
        last = F.size(h) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    return let(words(t), lambda own: let(F.transform(own, lambda w: F.xxhash64(w)), lambda h: _repeated(grams(h))))


def character_repetition(t: Column, n: int = 10) -> Column:
    """The share of the most frequent sqrt(number of distinct) character n-grams
    among all of them; n-grams that occur once don't count. In Arrow batches, as
    array work: a running polynomial gives the hash of each n-gram."""
    import numpy as np

    base = np.uint64(0xD6E8FEB86659FD93)

    def of(text: str) -> float:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        m = len(c) - n + 1
        if m <= 0:
            return 0.0
        c = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        c ^= c >> np.uint64(29)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h *= base
            h += c[k : k + m]
        h.sort()
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        counts = np.diff(at)
        k = min(int(len(counts) ** 0.5), int((counts > 1).sum()))
        return float(np.sort(counts)[len(counts) - k :].sum()) / m if k else 0.0

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else of(s) for s in x.to_pylist()], pa.float64())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(t)
