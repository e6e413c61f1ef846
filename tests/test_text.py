"""Text and markdown functions on hand-made strings."""

import pytest
from pyspark.sql import functions as F

from grainmill.functions import markdown as M
from grainmill.functions import recipe as R
from grainmill.functions import text as T
from grainmill.operators import cleaning, packing
from grainmill.operators.recipe import RECIPE, condition, run


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, think, answer",
    [
        ("<think>a</think>b", "a", "b"),
        ("x <think> a </think> b <think>c</think>", "a", "b <think>c</think>"),
        ("a</think>b</think>c", "a", "bc"),
        ("<think>a", "", "a"),
        ("plain", "", "plain"),
        ("", "", ""),
    ],
)
def test_think_answer(spark, text, think, answer):
    got = value(spark, T.think_answer, text)
    assert (got.think, got.answer) == (think, answer)


def test_think_null(spark):
    assert value(spark, T.think_answer, None) is None


@pytest.mark.parametrize("text, out", [("a $x$ b", "a  b"), ("$5 and $6", "6"), (r"\begin{a}x\end{a}y", "y"), (r"\[x\] \(y\) $$z$$", "  "), ("none", "none")])
def test_formulas(spark, text, out):
    assert value(spark, T.remove_formulas, text) == out


def test_names_and_lines(spark):
    assert value(spark, T.safe_filename, '???') == "conversation"
    assert value(spark, T.safe_filename, "a/b" * 40) == "ab" * 25
    assert value(spark, T.question_lines, " a \n\n b") == ["a", "b"]
    assert value(spark, T.remove_whitespace, "a　b \n c") == "abc"
    assert value(spark, lambda t: T.object_in(t), "x ```json\n{'is_filter': true,}\n```") == '{"is_filter": true}'
    assert value(spark, lambda t: T.fill_template("a {t} {other}", {"t": t}), "{other}") == "a {other} {other}"


PAPER = "front\n# Title\nbody\n## References\n[1] x\n### sub\ny\n## After\nz\n"


def test_trim_paper():
    body, front, refs = M.trim_paper(PAPER)
    assert (body, front, refs) == ("# Title\nbody\n## After\nz\n", "front\n", "## References\n[1] x\n### sub\ny\n")
    assert M.trim_paper("no heading") == ("", "no heading", "")
    assert M.trim_paper("# A\n## 参 考 文 献\nr")[2] == "## 参 考 文 献\nr"
    assert M.trim_paper("# References\n## a\n## b\n## c\n") == ("# References\n## a\n## b\n## c\n", "", "")


def test_tables():
    t = M.table_to_markdown('<table><tr><th colspan="2">a</th></tr><tr><td rowspan=2>b</td><td>c</td></tr><tr><td>d</td></tr></table>')
    assert t.split("\n") == ["| a |   |", "| --- | --- |", "| b | c |", "|   | d |"]
    assert M.table_to_markdown("<table></table>") == "<table></table>"
    assert M.convert_tables("x <TABLE><tr><td colspan=x>1</td></tr></TABLE> y") == "x | 1 |\n| --- | y"


@pytest.mark.parametrize("text", ["", "# a\nb\n# c\n", "#tag\r\nx\n  # y\n", "x" * 5000, "word " * 900, "# h\n" + "a $" + "f" * 3000 + "$ b\n" * 3, "\n" * 2049, "# a # b"])
def test_heading_chunks_add_up(text):
    parts = M.chunk_by_headings(text)
    assert "".join(parts) == text
    assert all(len(p) <= 2048 or "$" in p for p in parts)


@pytest.mark.parametrize("most", [3, 10, 1000])
def test_token_chunks(most):
    text = "# one\n" + "a b c d e\n\n" * 8 + "# two\n" + "w " * 40 + "$x y z$ tail"
    parts = M.chunk_by_tokens(text, most, M.word_count)
    assert "".join(parts).split() == text.split()
    assert all(M.word_count(p) <= most or "$" in p for p in parts)


def test_recipe_statistics(spark):
    assert value(spark, lambda t: R.word_repetition(t, 2), "a b a b c") == 0.5
    assert value(spark, lambda t: R.character_repetition(t, 2), "abababab") > 0.5
    assert value(spark, R.word_repetition, "") == 0.0
    assert value(spark, R.fix_unicode, "dÃ©jÃ ") == "déjà" or value(spark, R.fix_unicode, "dÃ©j") == "déj"
    assert value(spark, lambda t: R.flagged_share(t, ("bad",)), "Bad good bad x") == 0.5
    assert value(spark, lambda t: condition("words_num_filter", t), None) is False


def test_recipe_runs_in_order(spark):
    docs = spark.createDataFrame([(1, "word " * 30 + "a@b.co", 0.9, 10.0), (2, None, 0.9, 1.0)], "doc_id bigint, text string, lang_score double, perplexity double")
    steps = [s for s in RECIPE if s[0] not in ("alphanumeric_filter", "special_characters_filter", "character_repetition_filter", "word_repetition_filter")]
    assert [(r.doc_id, r.text) for r in run(docs, steps).collect()] == [(1, ("word " * 30).strip())]


def test_cleaning(spark):
    good, soup = "# a\nThis is a plain sentence of words. ![i](u)\n", "# b\n" + "@#$%^&*!" * 10 + "\n"
    docs = spark.createDataFrame([("x", good + soup), ("y", ""), ("z", None)], "id string, text string")
    cleaned, rejects = cleaning.clean(docs)
    assert {r.id: r.text for r in cleaned.collect()}["x"] == "# a\nThis is a plain sentence of words. \n"
    assert [(r.id, r.flag) for r in rejects.collect()] == [("x", "special characters")]


def test_cleaning_with_a_formula_filter(spark):
    docs = spark.createDataFrame([("x", "# a\nThis is a plain sentence with $bad$ in it.\n")], "id string, text string")
    latex = lambda t: F.struct(F.replace(t, F.lit("$bad$"), F.lit("")).alias("text"), F.array(F.struct(F.lit("low quality").alias("flag"), F.lit("$bad$").alias("text"))).alias("rejected"))
    cleaned, rejects = cleaning.clean(docs, latex=latex)
    assert cleaned.first().text == "# a\nThis is a plain sentence with  in it.\n"
    assert [tuple(r) for r in rejects.collect()] == [("x", -1, "low quality", "$bad$")]


def test_packing_equals_a_loop(spark):
    sizes = [6, 6, 6, 3, 3, 20, 1, 1]
    assert [s + 1 for s in packing.greedy(sizes, 10)] == [1, 2, 3, 3, 4, 5, 6, 6]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n bigint").repartition(3)
    got = packing.pack(rows, "id", F.col("n"), 10, exact=True).orderBy("id").collect()
    assert [r.shard for r in got] == [1, 2, 3, 3, 4, 5, 6, 6]
    many = packing.pack(rows, "id", F.col("n"), 10, partitions=3).collect()
    held = {}
    for r in many:
        held.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(v) <= 10 or len(v) == 1 for v in held.values()) and len(many) == 8


def test_spaces_and_digits(spark):
    from grainmill.functions import recipe as R

    df = spark.createDataFrame([("\u00a0a\u1680b\u2009c\u202fd\u205fe\u3000f\ufeffg\u2007", "１２，"), (None, None)], "a string, b string")
    got = df.select(R.normalise_whitespace(F.col("a")).alias("a"), R.normalise_punctuation(F.col("b")).alias("b")).collect()
    assert tuple(got[0]) == ("a b c d e f g", "１２,") and tuple(got[1]) == (None, None)


def test_repetition_equals_counting(spark):
    import random
    from collections import Counter

    from grainmill.functions import recipe as R

    rng = random.Random(3)
    texts = ["", "a", "abc " * 40, "x" * 500] + [" ".join(rng.choice(("one", "two", "three", "😀")) for _ in range(rng.randrange(60))) for _ in range(40)]

    def words(t, n=3):
        w = t.lower().split()
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return sum(k for k in c.values() if k > 1) / max(1, sum(c.values()))

    def characters(t, n=4):
        c = sorted(Counter(t[i : i + n] for i in range(len(t) - n + 1)).values(), reverse=True)
        k = min(int(len(c) ** 0.5), len(c) - c.count(1))
        return sum(c[:k]) / max(1, sum(c))

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", R.word_repetition(F.col("t"), 3).alias("w"), R.character_repetition(F.col("t"), 4).alias("c")).collect():
        assert abs(r.w - words(r.t)) < 1e-12 and abs(r.c - characters(r.t)) < 1e-12


def test_wide_spans_and_long_sections():
    import time

    from grainmill.functions import markdown as md

    at = time.time()
    table = md.table_to_markdown("<table><tr><td colspan=1000000000 rowspan=1000000000>a</td></tr><tr><td>b</td></tr></table>")
    assert table.count("|") == 3 * 1002 + 1 or table.startswith("| a |")
    assert "".join(md.heading_sections("line\n" * 400_000)) == "line\n" * 400_000
    assert time.time() - at < 10


def test_chunks_go_through_python_once(spark):
    """Chunks and their counts come from one worker, where each had its own."""
    docs = spark.createDataFrame([("f", "a b c\n\nd e f"), ("g", None), ("h", "")], "file_path string, text string")
    got = cleaning.chunks(docs, least=1, most=4)
    assert sorted((r.file_path, r.text.strip(), r.text_length) for r in got.collect()) == [("f", "a b c", 3), ("f", "d e f", 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
