"""Conversation operators on hand-made items."""

from pyspark.sql import functions as F

from grainmill.operators import conversations as C
from grainmill.operators import simhash
from grainmill.operators.components import components

M = "array<struct<role: string, content: string, think: string, answer: string>>"


def items(spark, *rows):
    return spark.createDataFrame([(f"k{i}", [(*m, None, None)[:4] if len(m) == 2 else m for m in r], "qs", "as") for i, r in enumerate(rows)], f"id string, messages {M}, query_source string, answer_source string")


def one(spark, f, *messages):
    return items(spark, messages).select(f(F.col("messages")).alias("x")).first().x


def test_sharegpt(spark):
    df = items(spark, [("user", "q"), ("assistant", None, "t", "a"), ("system", "s")])
    assert [(m.role, m.content) for m in C.to_sharegpt(df).first().messages] == [("user", "q"), ("assistant", "<think>\nt\n</think>\n\na"), ("system", "s")]


def test_labelling(spark):
    df = items(spark, [("user", "q"), ("assistant", ""), ("assistant", "<think>t</think>a")])
    r = C.to_labelling(df).first()
    a, b = r.conversation
    assert r.prompt == "q" and (a.message_type, a.user_id, a.parent_id) == ("send", "qs", None)
    assert (b.message_type, b.user_id, b.parent_id) == ("receive", "as", a.message_id)
    assert b.content == "## Reasoning\nt\n\n## Answer\na"


def test_merge(spark):
    df = items(spark, [("user", "q"), ("assistant", "a1")], [("assistant", "orphan")], [("user", "q"), ("assistant", "a2"), ("user", "q"), ("assistant", "a1")])
    (r,) = C.merge_by_first_query(df, C.first_query(F.col("messages")), "id").collect()
    assert (r["query"], r["first"], r.n_records, r.contents) == ("q", "k0", 2, ["q", "a1", "a2"])


def test_merge_labelling(spark):
    df = items(spark, [("user", "q"), ("assistant", "<think>t</think>a"), ("assistant", "")], [("assistant", "orphan")], [("user", "q"), ("assistant", "## Reasoning\nt\n\n## Answer\na"), ("assistant", "new"), ("user", "more"), ("assistant", "new")])
    (r,) = C.merge_labelling(df, "id", prompt="P").collect()
    assert (r["query"], r.prompt) == ("q", "P") and r.custom.asDict() == {"query_source": "qs", "answer_source": "as", "file_path": "", "source_chunk": ""}
    assert [(m.content, m.message_type, m.user_id) for m in r.conversation] == [("q", "send", "qs"), ("## Reasoning\nt\n\n## Answer\na", "receive", "as"), ("new", "receive", "as"), ("more", "send", "qs")]
    assert [m.parent_id for m in r.conversation] == [None, *[m.message_id for m in r.conversation[:-1]]]


def test_pairs(spark):
    talk = [("user", "q1"), ("user", "q2"), ("assistant", "a1"), ("assistant", "a2")]
    assert [tuple(p) for p in one(spark, C.pair_turns, *talk)] == [("q1", "a1"), ("q2", "a2")]
    assert one(spark, lambda m: C.pair_turns(m, strict=True), *talk) == []
    assert one(spark, C.as_text, ("user", "q"), ("assistant", "a")) == "Question 1: q\nAnswer 1:\nReasoning:\n\nFinal answer:\na"
    assert one(spark, C.as_text, ("user", "q"), ("assistant", None, "t", "b"), ("user", "x"), ("user", "y"), ("user", "r"), ("assistant", None, None, "c")) == "Question 1: q\nAnswer 1:\nReasoning:\nt\nFinal answer:\nb\nQuestion 3: r\nAnswer 3:\nReasoning:\n\nFinal answer:\nc"
    assert one(spark, C.pair_turns) == [] and one(spark, C.as_text) == ""
    assert one(spark, C.as_markdown, ("user", "q"), ("assistant", "a"), ("user", "r")) == "## Question 1\n\nq\n\n## Answer 1\n\na\n\n## Question 2\n\nr"
    assert one(spark, C.history, ("user", "q"), ("assistant", None)) == "Q: q\nA: "


def test_add_question(spark):
    own = spark.createDataFrame([([("user", "a")] * 9,), ([("user", "a")] * 10,)], "messages array<struct<role: string, content: string>>")
    assert [len(r.x) for r in own.select(C.add_question(F.col("messages"), "b").alias("x")).collect()] == [10, 10]


def test_resume_counts_missing_ids_as_empty(spark):
    todo = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "id string")
    done = spark.createDataFrame([("a",), (None,)], "id string")
    assert [r.id for r in C.resume(todo, done).collect()] == ["b"]


def test_cursor(spark):
    rows = spark.createDataFrame([(1,), (5,), (9,)], "id int")
    assert sorted(map(tuple, C.neighbours(rows, "id").collect())) == [(1, 1, 5, 9), (5, 2, 9, 1), (9, 3, 1, 5)]
    assert sorted(map(tuple, C.bounded_neighbours(rows, "id").collect()))[0] == (1, 1, 5, None)


def test_verdicts_and_order(spark):
    df = spark.createDataFrame([(1, (True, "x")), (2, (False, None)), (3, None)], "id int, v struct<is_filter: boolean, reason: string>")
    assert [r.id for r in C.accepted(df, ["v"]).collect()] == [2, 3]
    assert C.prioritise(df, ["v", "none"]).columns == ["v", "id"]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(31, 30), (32, 31), (5, 5)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(k, 0) for k in range(1, 21)} | {(31, 30), (32, 30)}


def test_simhash(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(1, text), (2, text.upper() + " ,"), (3, text + " more"), (4, "entirely other words in here " * 9), (5, None), (6, "..."), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {tuple(r) for r in simhash.pairs(docs).collect()}
    assert {(1, 2), (1, 3)} <= found and not {x for p in found for x in p} & {4, 5, 6}
    assert sorted(r.doc_id or 0 for r in simhash.deduplicate(docs).collect()) == [0, 1, 4, 5, 6]


def test_simhash_pairs_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    h = {r.id: r.h & (1 << 64) - 1 for r in simhash.hashes(docs).collect()}
    least = {}
    for i in sorted(h):
        least.setdefault(h[i], i)
    reps = sorted(least.values())
    want = {(a, b) for k, b in enumerate(reps) for a in reps[:k] if (h[a] ^ h[b]).bit_count() <= 4} | {(least[h[i]], i) for i in h if least[h[i]] != i}
    assert {tuple(r) for r in simhash.pairs(docs).collect()} == want


def test_merge_labelling_of_many_records_with_one_query(spark):
    """20,000 different contents of one query, copies among them: by comparing arrays this took minutes."""
    import time

    texts = [[("user", "q"), ("assistant", f"a{k % 15_000}"), ("assistant", f"b{k}")] for k in range(20_000)]
    rows = spark.createDataFrame([(k, [dict(role=r, content=c) for r, c in t]) for k, t in enumerate(texts)], "id int, messages array<struct<role: string, content: string>>")
    began = time.time()
    (r,) = C.merge_labelling(rows.withColumns({"query_source": F.lit("qs"), "answer_source": F.lit("as")}), "id").collect()
    took = time.time() - began
    want = list(dict.fromkeys(c for t in texts for _, c in t))
    assert [m.content for m in r.conversation] == want and took < 60


def test_merge_labelling_of_empty_turns(spark):
    """A leading record without a text still gives the custom fields."""
    rows = spark.createDataFrame([(1, "first", [("assistant", "")]), (2, "second", [("user", "x"), ("assistant", None)]), (3, "third", [("user", "x")])], "id int, file_path string, messages array<struct<role: string, content: string>>")
    rows = rows.withColumns({"query_source": F.lit("qs"), "answer_source": F.lit(None).cast("string")})
    (r,) = C.merge_labelling(rows, "id", key=F.lit("k")).collect()
    assert r.custom.file_path == "first" and [m.content for m in r.conversation] == ["x"]
    (r,) = C.merge_labelling(rows.where("id = 1"), "id", key=F.lit("k")).collect()
    assert r.custom.file_path == "first" and r.conversation == []
