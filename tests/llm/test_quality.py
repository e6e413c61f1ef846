"""Compression classifier: held-out accuracy and special cases."""

import pytest

from grainmill.llm import quality as Q

T = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{T}/{n}.parquet") for n in ("documents", "labels"))
    m = Q.train(docs, labels)
    assert m == Q.train(docs, labels)  # the same sample and fit each time
    return m


def test_accuracy_on_texts_of_another_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = Q.scores(docs, model).join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97
    assert 1 - sum(bad) / len(bad) > 0.85


def test_table_equals_plain_compression(spark, model):
    """d anew from two compressors without shared state, and the logistic curve by its formula."""
    import math

    import zstandard as zstd

    def size(dictionary, data):
        return len(zstd.ZstdCompressor(level=Q.LEVEL, dict_data=zstd.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False).compress(data))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.scores(docs, model).collect():
        data = texts[r.doc_id].encode()
        parts = [data[k : k + Q.PIECE] for k in range(0, len(data), Q.PIECE)]
        g, b = sum(size(model.good, p) for p in parts), sum(size(model.bad, p) for p in parts)
        d = (b - g) / (b + g + Q.SMOOTH)
        rep = max(0, model.low - math.log(g / len(data)))
        assert abs(r.size_difference - d) < 1e-12 and abs(r.repetition - rep) < 1e-12
        score = 1 / (1 + math.exp(-(model.slope * d + model.per_repetition * rep + model.intercept)))
        assert abs(r.score - score) < 1e-9 and r.kept == (r.score >= Q.KEEP_FROM)


def test_difference_is_over_the_whole_text(model):
    d = Q.difference(model)
    a, b = "and the thing of erinher was thatnd " * 60, "ERTION!! IN!! THEA.!! WHSH!! " * 300
    pieces = [len(x) for x in Q._pieces(a + b)]
    assert sum(pieces) == len(a + b)
    assert d(a)[0] > d(a + b)[0] > d(b)[0]


def test_one_word_repeated_is_bad(model):
    (_, r, score, kept), (_, plain, *_) = Q.judge(model)(["Thisword " * 400, "and the thing of erinher was thatnd"])
    assert r > 1 and plain == 0 and score < Q.KEEP_FROM and not kept


def test_special_cases(spark, model):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "and the thing of it was"), (4, "x" * 300_000), (4, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    got = Q.scores(docs, model).collect()
    assert len(got) == 6
    assert all(r.score is None and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert len({tuple(r) for r in got if r.doc_id == 4}) == 1
    assert all(0 <= r.score <= 1 for r in got if r.score is not None)
    assert Q.scores(docs.limit(0), model).collect() == []


def test_without_enough_labels_everything_stays(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    assert Q.train(docs, labels) is None
    assert Q.train(docs, labels.limit(0)) is None
    assert [(r.score, r.kept) for r in Q.scores(docs, None).orderBy("doc_id").collect()] == [(None, True), (None, False)]
