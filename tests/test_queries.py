"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import math

import duckdb
import pytest

from grainmill import queries as Q
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(float(v), 7)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLES[name])
    have = [x[0] for x in cur.description]
    assert sorted(have) == sorted(df.columns)
    at = [have.index(c) for c in df.columns]
    want = sorted(tuple(norm(r[k]) for k in at) for r in cur.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_others_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert Q.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("dist_source", "source"), ("per_source_progress", "source"), ("distinct_languages", "lang"), ("corpus_summary", "lang")])
def test_texts_are_not_read_where_they_are_not_needed(spark, name, columns):
    read = [x for x in plan(Q.QUERIES[name](spark, SF)).split("ReadSchema: ")[1:] if columns in x.split(">")[0]]
    assert read and all("text:" not in x.split(">")[0] for x in read)


def test_filters_reach_the_scan(spark):
    scans = plan(Q.QUERIES["corpus_summary"](spark, SF)).split("PushedFilters: ")[1:]
    assert any("EqualTo(lang,en)" in x.split("]")[0] for x in scans)


def test_rounding_is_that_of_sql(spark, tmp_path):
    """A text of 5,120 characters, 323 of them signs: the share is a tie in decimal, but not in binary."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["." * 323 + "a" * 4797, "." * 9 + "a" * 1015]}), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    name = "stat_special_characters_filter"
    want = dict(c.execute(Q.ORACLES[name]).fetchall())
    assert {r.doc_id: r.out for r in Q.QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert Q.rounded_number(323 / 5120) == want[1] != round(323 / 5120 + 1e-12, 9)


def test_guarded_transform_upper_case_is_that_of_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["ß859", "ŉx", "ᾳ", "ﬁ", "é", "", "z"]
    pq.write_table(pa.table({"doc_id": pa.array([1 + 3 * k for k in range(len(texts))], pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(c.execute(Q.ORACLES["guarded_transform"]).fetchall())
    assert sorted(map(tuple, Q.QUERIES["guarded_transform"](spark, str(tmp_path)).collect())) == want


def test_cleaned_output_keeps_empty_texts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 5, 6, 7], pa.int64()), "text": ["", "a b", "", "%&" * 20, None]}), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("cleaned_output", "reject_log"):
        df = Q.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall())


def test_chunks_are_judged_once(spark):
    """The optimiser put 84 regular expressions into the plan of the rejects, copies of nine."""
    from grainmill.operators import cleaning

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in cleaning.clean(docs, "doc_id"):
        assert plan(df).count("regexp_replace") < 12
