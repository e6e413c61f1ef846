"""Readers, writers, model calls and streams, on files of the test's own."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill import plans, streaming
from grainmill.operators import model_calls as L
from grainmill.sources import readers as R
from grainmill.sources import sinks as S


def line(k, **over):
    return json.dumps({"id": f"i{k}", "text": f"text {k}", "metadata": {"source": "s", "category": "ab"[k % 2], "domain": "d", "language": "en", "token_count": 100, **over}})


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    good = [line(k) for k in range(40)]
    bad = ["{broken", "", json.dumps({"text": "x", "metadata": 5}), json.dumps({"text": "x"}), line(90, token_count="abc"), line(91, token_count=float("inf")), line(92, source=None), line(93, token_count=None)]
    (tmp_path / "in/a.jsonl").write_text("\n".join(good[:20] + bad))
    (tmp_path / "in/sub/b.JSONL").write_text("\n".join(good[20:] + [line(94, token_count=" 12.7 ")]) + "\n")
    (tmp_path / "in/c_F.jsonl").write_text(line(95))
    (tmp_path / "in/d.txt").write_text(line(96))
    return tmp_path


def test_index(spark, corpus):
    got = R.typed(R.json_lines(spark, str(corpus / "in"), exclude_suffix="_F.jsonl"), nested=True, with_text=False).collect()
    assert sorted(r.id for r in got) == sorted([f"i{k}" for k in range(40)] + ["i94"])
    assert {r.token_count for r in got} == {100, 12}
    parity = R.typed(R.json_lines(spark, str(corpus / "in")), nested=True, null_as="None").where("id = 'i92'").first()
    assert parity.source == "None"
    import hashlib

    r = next(r for r in got if r.id == "i3")
    assert r.line_hash == hashlib.md5((line(3) + "\n").encode()).hexdigest()
    # 40 good lines, five odd ones that are JSON (Infinity isn't), "12.7" and the tool's own output
    assert R.tolerant(spark, str(corpus / "in"), "id string").count() == 47
    assert R.diagnose(spark, str(corpus / "in"), ".jsonl")["files"] == 2
    assert R.tree(spark, str(corpus / "in"), ["sub"], ["d.txt"])[1] == ["a.jsonl", "c_F.jsonl"] and R.tree(spark, "/no/such") == (None, None)


def test_mix_files(spark, corpus):
    plans.mix_files(spark, str(corpus / "in/sub"), str(corpus / "out"), {"category": {"a": 0.4, "b": 0.6}}, 1000, 500)
    rows = [json.loads(x) for p in (corpus / "out").rglob("*.txt") for x in p.read_text().splitlines()]
    assert rows and all(r["text"] == f"text {r['id'][1:]}" for r in rows)
    for p in (corpus / "out").glob("shard=*"):
        size = sum(len(f.read_bytes()) for f in p.glob("*.txt"))
        assert size <= 500
    with pytest.raises(ValueError):
        plans.mix_files(spark, str(corpus / "in"), str(corpus / "o2"), {"category": {"a": 0.3, "zz": 0.7}}, 1000, 500)


def test_verified_texts(spark):
    lines = spark.createDataFrame([(line(1), "f"), (line(1), "f"), ("{bad", "f"), (line(2), "f")], "value string, file_path string")
    h = F.md5(F.concat("value", F.lit("\n")))
    want = lines.select(F.lit("i1").alias("id"), "file_path", h.alias("line_hash")).distinct().union(spark.createDataFrame([("i9", "f", "nohash")], "id string, file_path string, line_hash string"))
    assert sorted(r.status for r in R.verified_texts(want, lines).collect()) == ["invalid", "missing", "ok", "other_id"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * k, None, "/p/f%d.parquet" % (k % 2)) for k in range(1, 8)], "id bigint, text string, note string, file_path string")
    S.write_mirrored(df, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").glob("src_file=*")} == {"src_file=%2Fp%2Ff0.parquet", "src_file=%2Fp%2Ff1.parquet"}
    assert json.loads(next((tmp_path / "m/src_file=%2Fp%2Ff0.parquet").glob("*.txt")).read_text().splitlines()[0]).keys() == {"id", "text", "note"}
    same = df.withColumn("file_path", F.when(F.col("id") % 2 == 0, "file:/r/a/x.parquet").otherwise("file:///r/b/x.parquet"))
    S.write_mirrored(same, str(tmp_path / "mm"), root="/r/")
    assert {p.name for p in (tmp_path / "mm").glob("src_file=*")} == {"src_file=a%2Fx.parquet", "src_file=b%2Fx.parquet"}
    twice = spark.createDataFrame([("k", "same"), ("k", "same"), ("k", "same"), ("k", "other"), (None, "x")], "k string, text string")
    for exact in (True, False):
        plan = S.write_shards(twice, str(tmp_path / f"s{exact}"), 60, "k", exact=exact)
        assert plan.count() == 5
        lines = [x for p in (tmp_path / f"s{exact}").rglob("*.txt") for x in p.read_text().splitlines()]
        assert sorted(lines) == sorted(json.dumps({"k": k, "text": t}, separators=(",", ":")) for k, t in [("k", "same")] * 3 + [("k", "other"), (None, "x")])
    S.write_limited(df, str(tmp_path / "l"), 2)
    assert R.dataset(spark, str(tmp_path / "l")).count() == 7
    df.drop("file_path").write.parquet(str(tmp_path / "p/q"))
    assert R.parquet(spark, str(tmp_path / "p")).count() == 7
    (tmp_path / "md/sub").mkdir(parents=True)
    (tmp_path / "md/a.md").write_text("# x\nfoo\n")
    (tmp_path / "md/sub/b.md").write_text("no")
    assert [r.text for r in R.markdown(spark, str(tmp_path / "md")).collect()] == ["# x\nfoo\n"]
    assert R.training_mix([(df.select("id"), 2), (df.select("id"), 3)]).count() == 5


def test_configuration():
    assert R.models("p,n,k; p2,n2,k2")[1]["model_name"] == "n2" and R.models('{"models": [{"a": 1}]}') == [{"a": 1}] and R.models("models:\n  - a: 1\n") == [{"a": 1}]
    with pytest.raises(ValueError):
        R.models("p,n")
    good = {"api_path": "p", "model_name": "n", "api_key": "k"}
    assert R.invalid_model(good) is None and R.invalid_model({**good, "concurrency": 0}) and R.invalid_model({**good, "model_type": "x"}) and R.invalid_model({})
    assert R.prompt({"en": {"q": "t"}}, "en", "q") == "t" and R.prompt({}, "en", "q", "d") == "d"


def test_model_calls(spark):
    def factory():
        def client(messages):
            text = messages[-1]["content"]
            if "boom" in text:
                raise RuntimeError("down")
            return f"<think>t</think>{text}!"

        return client

    rows = spark.createDataFrame([(1, "hi"), (2, "boom"), (3, None)], "id int, q string")
    got = {r.id: r.reply for r in L.ask(rows, F.when(F.col("q").isNotNull(), F.array(L.message("user", F.col("q")))), factory, tries=2, delay=0).collect()}
    assert (got[1].think, got[1].answer, got[1].error) == ("t", "hi!", None) and "down" in got[2].error and got[3] is None
    answers = spark.createDataFrame([('{"is_filter": true, "reason": "r"}',), ("x {'is_filter': false,} y",), ("[1]",), (None,)], "a string")
    assert [r.x.is_filter for r in answers.select(L.verdict(F.col("a")).alias("x")).collect()] == [True, False, False, False]
    scores = spark.createDataFrame([('{"score": "7.5"}',), ("none",)], "a string")
    assert [r.x.score for r in scores.select(L.score(F.col("a"), 10).alias("x")).collect()] == [7.5, 10.0]
    calls = []
    with pytest.raises(RuntimeError):
        L.with_retry(lambda: calls.append(1) or (_ for _ in ()).throw(RuntimeError("x")), sleep=lambda s: calls.append(s))
    assert calls == [1, 1.5, 1, 2.5, 1, 4.5, 1]


def stub():
    def client(m):
        p = m[-1]["content"]
        if "boom" in p:
            raise RuntimeError("down")
        if p.startswith("ASK"):
            return "q1\n\nq2"
        if p.startswith("QF"):
            return '{"is_filter": true, "reason": "poor"}' if "q1" in p else "no object"
        if p.startswith("AF"):
            return '{"is_filter": true, "reason": "wrong"}' if "bad" in p else '{"is_filter": false}'
        if p.startswith("QS"):
            return '{"score": 3, "reason": "low"}' if "low" in p else '{"score": "8"}'
        return f"<think>x</think>re: {p[:20]}"

    return client


PROMPTS = {"question": "ASK {n} {text}", "answer": "A {question}", "follow_up": "F {history}", "rewrite": "R {answer}", "question_filter": "QF {question}", "answer_filter": "AF {qa_pair}", "qa_score": "QS {qa_pair} {ref_paper}"}


def test_dialogues(spark):
    items = spark.createDataFrame([("a", "some text", 10), ("b", "other", 5000)], "id string, text string, text_length int")
    got = plans.synthesise(items, stub, PROMPTS, done=spark.createDataFrame([("b",)], "id string")).collect()
    assert {(r.id, r.question_no) for r in got} == {("a", 0), ("a", 1)}
    assert all(m.role == ("user", "assistant")[k % 2] for r in got for k, m in enumerate(r.messages))
    rows = L.dialogues(items, stub, PROMPTS).collect()
    assert sorted({r.task for r in rows}) == ["dialogue", "max_filter", "max_question", "plus_answer"] and len(rows) == 16
    by = {(r.id, r.question_no, r.task): r.messages for r in rows}
    talk, asks, rewrites, plus = (by["a", 0, t] for t in ("dialogue", "max_question", "max_filter", "plus_answer"))
    assert len(talk) == len(asks) == len(rewrites) and len(plus) == 2
    assert asks[0].content == "ASK 1 some text" and asks[1].content == "q1\n\nq2"
    assert rewrites[0].content == "R re: A q1" and rewrites[1].content == talk[1].think
    assert plus[1].content == "<think>\nx\n</think>\n\nre: A q1"
    failed = spark.createDataFrame([("c", "boom", 1)], "id string, text string, text_length int")
    import grainmill.operators.model_calls as mc

    keep, mc.time.sleep = mc.time.sleep, lambda s: None
    try:
        (r,) = L.dialogues(failed, stub, PROMPTS).collect()
    finally:
        mc.time.sleep = keep
    assert r.task == "error" and "down" in r.error


def test_distil(spark):
    m = "array<struct<role: string, content: string>>"
    items = spark.createDataFrame([("own", "t", 1, [("user", "mine"), ("assistant", "x"), ("user", "bad")]), ("asked", "t", 1, None), ("low", "low", 1, [("user", "z")])], f"id string, text string, text_length int, messages {m}")
    got = {(r.id, r.question_no): r for r in L.distil(items, stub, PROMPTS, ("question_filter", "answer_filter", "qa_score"), messages_col="messages", multi_turn=False).collect()}
    assert set(got) == {("own", 0), ("own", 1), ("asked", 0), ("low", 0)}
    assert got["own", 0].task == "dialogue" and got["own", 0].score == 8 and got["own", 0].messages[0].content == "mine"
    assert got["own", 1].task == "rejected" and "wrong" in got["own", 1].error
    assert got["asked", 0].messages[0].content == "q2"
    assert got["low", 0].task == "rejected" and got["low", 0].score == 3
    plain = L.distil(items.where("id = 'asked'"), stub, {**PROMPTS, "question_filter": "QF q1 {question}"}, ("question_filter",), messages_col="messages", multi_turn=False).collect()
    assert [r.messages[0].content for r in plain] == ["q1"] and plain[0].score == 10  # the first stays where none would


def test_filtered(spark):
    m = "array<struct<role: string, content: string, think: string, answer: string>>"
    items = spark.createDataFrame([(k, "low" if k == "d" else "t", [("user", q, None, None), ("assistant", None, "th", "an")]) for k, q in (("a", "fine"), ("b", "q1"), ("c", "bad"), ("d", "x"))], f"id string, text string, messages {m}")
    kept, rejects = L.filtered(items, stub, PROMPTS)
    assert [(r.id, r.score) for r in kept.collect()] == [("a", 8.0)] and kept.columns == ["id", "text", "messages", "score"]
    assert sorted((r.id, r.filter, r.reason) for r in rejects.collect()) == [("b", "question_filter", "poor"), ("c", "answer_filter", "wrong"), ("d", "qa_score", "low")]


def test_guarded(spark):
    from grainmill.operators.cleaning import guarded

    def f(t):
        if t == "slow":
            import time

            time.sleep(30)
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    docs = spark.createDataFrame([(1, "ok"), (2, "slow"), (3, "bad"), (4, None), (5, "")], "id int, text string")
    got = {r.id: (r.text, r.status) for r in guarded(docs, f, seconds=1).collect()}
    assert got == {1: ("OK", "ok"), 2: ("slow", "timeout"), 3: ("bad", "error: ValueError: no"), 4: (None, "null"), 5: ("", "ok")}


def test_stream_export(spark, corpus):
    lines = streaming.json_lines(spark, str(corpus / "in/sub"))
    rows = streaming.sampled(lines, {"category": {"a": 1.0, "b": 0.0}}).select("id", "line_hash")
    out = str(corpus / "shards")
    streaming.export(rows, out, 200, "id", str(corpus / "ck2")).awaitTermination(120)
    got = spark.read.text(out)
    assert {json.loads(r.value)["id"] for r in got.collect()} == {f"i{k}" for k in range(20, 40, 2)} | {"i94"}


def test_stream_equals_batch(spark, corpus):
    weights = {"category": {"a": 0.5, "b": 0.9}}
    batch = streaming.sampled(R.json_lines(spark, str(corpus / "in/sub")), weights)
    want = sorted(r.id for r in batch.collect())
    out = str(corpus / "stream")
    lines = streaming.json_lines(spark, str(corpus / "in/sub"), files_per_trigger=1)
    for _ in range(2):  # the second start finds nothing new
        q = streaming.run(streaming.sampled(lines, weights), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}"), str(corpus / "ck"))
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == want and want


def test_offsets_and_choice(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes("é\nab\r\nlast".encode())
    assert sorted(r.offset for r in R.byte_offsets(spark, str(tmp_path)).collect()) == [0, 3, 7]
    models = [{"model_type": "instruct", "n": 1}, {"model_type": "thinking", "n": 2}]
    assert R.choose_model(models, "instruct")["n"] == 1 and R.choose_model(models, "mix", 5)["n"] == 2 and R.choose_model(models[:1], "mix")["n"] == 1
    with pytest.raises(ValueError):
        R.choose_model([], "mix")


def test_event_time_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:10", 1.0), ("a", "2026-01-01 00:00:50", 2.0), ("b", "2026-01-01 00:01:10", 4.0)], "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    df.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = streaming.token_windows(s, "t", "k", "v", "1 minute", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.total, r.n) for r in spark.table("w").collect()) == [("a", 3.0, 2), ("b", 4.0, 1)]


def test_write_files_holds_no_file(spark, tmp_path):
    """A worker's memory doesn't grow with the file it writes: 300 MB, of which lists and joined text took over a GB."""
    from grainmill.file_queries import write_files

    def most(batches):
        import resource

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * b.num_rows, pa.int64())], names=["mb"])

    look = lambda: max(r.mb for r in spark.range(0, 64, 1, 16).mapInArrow(most, "mb bigint").collect())
    before = look()
    write_files(spark.range(0, 300_000, 1, 8).select(F.lit("a.txt").alias("name"), F.repeat(F.lit("x"), F.lit(1000)).alias("value")), str(tmp_path / "w"))
    assert (tmp_path / "w/a.txt").stat().st_size == 300_000 * 1001
    assert look() < max(before, 150) + 150


def test_each_corpus_file_is_a_task_of_its_own(spark, tmp_path):
    """The largest task's share of the rows is that of one of 30 files."""
    from grainmill import file_queries as Q

    seen, write = [], S.write_named
    try:
        S.write_named = lambda rows, out, end="\n": seen.append(rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("name").alias("k")).collect()) or write(rows, out, end)
        spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
        Q.corpus(spark, str(tmp_path))
    finally:
        S.write_named = write
    assert max(r.n for r in seen[0]) == 100 and sum(r.n for r in seen[0]) == 3003 and len(seen[0]) == 31


def test_overwritten_folders_are_whole(spark, tmp_path):
    """Folders of shards and of conversations have one file each, nothing is left of an earlier save, and a failed one changes nothing."""
    out = tmp_path / "s"
    for n in (40, 10):
        S.write_shards(spark.range(n).selectExpr("id", "repeat('é', 20) AS text"), str(out), 120, "id", exact=True)
        assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == sorted(f"shard={k}/part-00000.txt" for k in range(1, n // 2 + 1))
    assert sorted(json.loads(x)["id"] for p in out.rglob("*.txt") for x in p.read_text().splitlines()) == list(range(10))
    with pytest.raises(Exception, match="[Dd]ivision|DIVIDE"):
        S.write_named(spark.range(9).select(F.lit("a").alias("name"), F.expr("cast(raise_error('division') as string)").alias("value")), str(out))
    assert len(list(out.glob("shard=*"))) == 5 and [p.name for p in tmp_path.iterdir()] == ["s"]
    S.write_shards(spark.range(4).selectExpr("id", "'a' AS text"), str(out), 120, "id", mode="append")
    assert spark.read.text(str(out)).count() == 14
    talk = spark.createDataFrame([(1, [("user", "q")]), (2, [])], "id bigint, messages array<struct<role: string, content: string>>")
    for rows in (talk, talk.where("id = 1")):
        S.write_markdown(rows, str(tmp_path / "m"))
    assert [str(p.relative_to(tmp_path / "m")) for p in (tmp_path / "m").rglob("*") if p.is_file()] == ["item=1/part-00000.txt"]
    assert (tmp_path / "m/item=1/part-00000.txt").read_text() == "## Question 1\n\nq\n"
    S.write_markdown(talk.withColumn("id", F.lit("a/b")).limit(1), str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").glob("item=*")] == ["item=a%2Fb"]
