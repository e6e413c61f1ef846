"""The pipeline's stages, one by one, against what they should keep."""

import corpus_pipeline as P
from grainmill.llm import decontaminate, near_dedup, quality, toxicity
from tests.llm.test_near_dedup import brute

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]
    labels, bench = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("labels", "benchmark"))
    rows = [tuple(r) for r in docs.collect()]
    at, judge = docs.columns.index("text"), quality.judge(quality.train(docs, labels))
    index = decontaminate.Index([(r.item_id, r.text) for r in bench.collect()])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()))
        if name == "quality":
            keep = [k for *_, k in judge([r[at] for r in rows])]
        elif name == "toxicity":
            keep = [toxicity.judge(r[at])[0] < 1 for r in rows]
        elif name == "near_dedup":
            gone = {i for i, _ in brute([(r[0], r[at]) for r in rows])}
            keep = [r[0] not in gone for r in rows]
        else:
            bad = {d for d, *_ in decontaminate._found(index, [r[at] for r in rows])}
            keep = [k not in bad for k in range(len(rows))]
        rows = [r for r, k in zip(rows, keep) if k]
        assert got == sorted(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = {}
    for r in P.STAGES[-1][1](spark, docs, D).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {r[0]: len(r[at].encode()) + 1 for r in rows}


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D)
    assert sorted(map(str, P.run(spark, D).collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_pass_through(spark):
    """Nulls in any column, clashing columns, repeated rows."""
    text = "and the thing of it was then there with this and that for the other one at last "
    rows = [(None, text * 3, None, None, None, 1), (1, None, "en", "s", 0, 1), (2, "", "en", None, 0, 1), (3, text * 5, None, "s", None, 2), (3, text * 5, None, "s", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), D).collect() == []
        docs = out
    assert [r.doc_id for r in docs.collect()].count(3) in (0, 2)
    assert near_dedup is not None


def test_without_labels_and_benchmark(spark, tmp_path):
    """Empty side tables: texts pass, but for blank and openly toxic ones."""
    text = "and the thing of it was then there with this and that for the other one at last "
    docs = spark.createDataFrame([(1, text * 2), (2, " "), (3, "you idiot. I will kill you."), (4, text * 2), (5, text * 4000)], "doc_id bigint, text string").selectExpr("*", "'en' as lang")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {1, 5}


def test_by_key_gives_the_same_by_shuffle(spark, monkeypatch):
    from grainmill.llm import _common

    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(40)], "doc_id bigint, n int")
    keys = spark.createDataFrame([(1,), (3,), (9,)], "doc_id bigint")
    for how in ("left_semi", "left_anti"):
        small = sorted(map(str, _common.by_key(df, keys, "doc_id", how).collect()))
        monkeypatch.setattr(_common, "BROADCAST_KEYS", -1)
        assert sorted(map(str, _common.by_key(df, keys, "doc_id", how).collect())) == small
        monkeypatch.undo()


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from grainmill.llm import _common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        _common.scratch_root(Session())
