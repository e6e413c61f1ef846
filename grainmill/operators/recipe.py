"""A declarative cleaning recipe: a list of (operator, parameters), applied in order.

Filters add their statistic only while they run; neighbouring filters and mappers
are one projection for Catalyst, so the text is read once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import recipe as R
from grainmill.operators import simhash

MAPPERS = {
    "clean_email_mapper": R.clean_email,
    "clean_links_mapper": R.clean_links,
    "fix_unicode_mapper": R.fix_unicode,
    "punctuation_normalization_mapper": R.normalise_punctuation,
    "whitespace_normalization_mapper": R.normalise_whitespace,
}
#: name -> (statistic of the text column, parameters and their defaults)
FILTERS = {
    "alphanumeric_filter": (lambda t, p: R.alphanumeric_share(t), {"min_ratio": 0.7508, "max_ratio": 0.8591}),
    "average_line_length_filter": (lambda t, p: R.average_line_length(t), {"max_len": 1500}),
    "character_repetition_filter": (lambda t, p: R.character_repetition(t, p["rep_len"]), {"rep_len": 10, "max_ratio": 0.3}),
    "flagged_words_filter": (lambda t, p: R.flagged_share(t, p["words"]), {"words": (), "max_ratio": 0.0015}),
    "language_id_score_filter": (lambda t, p: F.col(p["column"]), {"column": "lang_score", "min_score": 0.793}),
    "maximum_line_length_filter": (lambda t, p: R.maximum_line_length(t), {"max_len": 5000}),
    "perplexity_filter": (lambda t, p: F.col(p["column"]), {"column": "perplexity", "max_ppl": 5000}),
    "special_characters_filter": (lambda t, p: R.special_share(t), {"min_ratio": 0.15, "max_ratio": 0.35}),
    "text_length_filter": (lambda t, p: F.length(t), {"max_len": 58187}),
    "words_num_filter": (lambda t, p: R.word_count(t), {"min_num": 20, "max_num": 11529}),
    "word_repetition_filter": (lambda t, p: R.word_repetition(t, p["rep_len"]), {"rep_len": 10, "max_ratio": 0.2962}),
}


def condition(name: str, text: Column, params: Mapping | None = None) -> Column:
    """Whether a text passes a filter; a null statistic doesn't."""
    stat, defaults = FILTERS[name]
    p = {**defaults, **(params or {})}
    value, ok = stat(text, p), F.lit(True)
    for k, bound in p.items():
        if k.startswith("min_"):
            ok = ok & (value >= bound)
        elif k.startswith("max_"):
            ok = ok & (value <= bound)
    return F.coalesce(ok, F.lit(False))


def run(docs: DataFrame, steps: Sequence[tuple[str, Mapping]], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Applies the steps in order."""
    for name, params in steps:
        if name == "document_simhash_deduplicator":
            docs = simhash.deduplicate(docs, id_col, text, window=params.get("window_size", 6), most=params.get("hamming_distance", 4))
        elif name in MAPPERS:
            docs = docs.withColumn(text, MAPPERS[name](F.col(text)))
        else:
            docs = docs.where(condition(name, F.col(text), params))
    return docs


#: The order of the recipe: duplicates, then mappers, then filters.
RECIPE: tuple[tuple[str, Mapping], ...] = (("document_simhash_deduplicator", {}), *((m, {}) for m in MAPPERS), *((f, {}) for f in FILTERS))
