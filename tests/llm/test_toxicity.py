"""The composed clause grammar, and the decision by document."""

import pytest

from grainmill.llm import toxicity as X


@pytest.mark.parametrize(
    "clause, least, most",
    [
        ("you are an idiot", 1.5, 1.7),
        ("the idiot came", 1.1, 1.2),
        ("idiot", 1.0, 1.0),
        ("you are not an idiot", 0.2, 0.3),
        ("she said you are an idiot", 0.5, 0.6),
        ("he said you are not an idiot", 0.05, 0.1),
        ("I will kill you", 2.6, 2.6),
        ("I will never kill you", 0.3, 0.4),
        ("kill you", 2.0, 2.0),
        ("kill the process", 0, 0),
        ("I will kill time", 0, 0),
        ("a pleasant day", 0, 0),
        ("du bist ein Arschloch", 1.5, 1.7),
        ("You’re scum", 1.7, 1.8),
        ("", 0, 0),
        ("the idiot's work", 1.1, 1.2),
        ("you idiotic fool", 1.5, 1.7),
        ("l'imbécile", 1.0, 1.2),
    ],
)
def test_clauses(clause, least, most):
    assert least - 1e-9 <= X.clause_score(clause)[0] <= most + 1e-9


def cascade(symbols):
    """The five transducers one after the other, without composing them."""
    total = [1.0] * len(symbols)
    for t in (X._target(), X._threat(), X._negation(), X._reported(), X._weights()):
        s, out = next(iter(t)), []
        for k, a in enumerate(symbols):
            b, w, s = t[s][a]
            total[k] *= w
            out.append(b)
        symbols = out
    return sum(total)


def test_composition_equals_the_cascade():
    import random

    rng = random.Random(4)
    nxt, weight, _ = X.grammar()
    for _ in range(500):
        symbols = [rng.choice(X.CLASSES) for _ in range(rng.randrange(12))]
        s, total = 0, 0.0
        for a in symbols:
            c = X.CLASSES.index(a)
            total, s = total + weight[s][c], nxt[s][c]
        assert abs(total - cascade(symbols)) < 1e-12


def test_clause_edges_and_positions():
    text = "Nothing here. He said no! you idiot; fine\nthe scum"
    found = X.clauses(text)
    assert [text[a:b].strip() for a, b, _, _ in found] == ["you idiot", "the scum"]


def by_rules(words):
    """A clause's score by rules read off the grammar's description, without machines."""
    cls = [next((n for n, own in X._WORDS.items() if w in own.split()), "OTH") for w in words]
    marks, aim, meant, hit, said = [], ("", 0), 0, 0, False
    for c in cls:
        mark = None
        if c == "INS":
            mark = {"YOU": 1.6, "AIM": 1.15, "": 1.0}[aim[0] if aim[1] else ""]
        elif c in ("YOU", "AIM"):
            if hit:
                mark = 2.6
            elif said and c == "YOU":
                mark = 2.0
        marks.append(mark)
        # who is spoken of; an insult leaves that as it was
        if c in ("YOU", "AIM"):
            aim = (c, 4 if c == "YOU" else 2)
        elif c != "INS":
            aim = (aim[0], max(0, aim[1] - 1))
        # threats: the verb, behind an intention up to three words back or alone
        if c == "INT":
            meant, hit, said = 3, 0, False
        elif c == "THR":
            meant, hit, said = (0, 3, False) if meant else (0, 0, True)
        elif mark in (2.6, 2.0):
            meant, hit, said = 0, 0, False
        else:
            meant, hit, said = max(0, meant - 1), max(0, hit - 1), False
    total = 0.0
    for k, m in enumerate(marks):
        if m is not None:
            m *= 0.15 if "NEG" in cls[max(0, k - 4) : k] else 1
            m *= 0.35 if "REP" in cls[:k] else 1
            total += m * (X._SEVERITY.get(words[k], 1.0))
    return total


def test_score_equals_rules():
    import random

    rng = random.Random(5)
    some = ["idiot", "scum", "kill", "hurt", "you", "the", "not", "said", "will", "would", "tree", "runs", "dumb"]
    hits = 0
    for _ in range(3000):
        words = [rng.choice(some) for _ in range(rng.randrange(1, 10))]
        want = by_rules(words)
        hits += want > 0
        assert abs(X.clause_score(" ".join(words))[0] - want) < 1e-9, words
    assert hits > 1000


def worst(text):
    """The worst passage, by trying every pair of clauses."""
    found = X.clauses(text)
    return max((sum(c[3] for c in found[i : j + 1]) for i in range(len(found)) for j in range(i, len(found)) if i == j or found[j][1] - found[i][0] <= X.SPAN), default=0.0) / X.ENOUGH


def test_worst_passage():
    import random

    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["the idiot. ", "a clown sat. ", "word " * rng.randrange(60), "nothing here. ", "you fool. "]) for _ in range(20))
        assert abs(X.judge(text)[0] - worst(text)) < 1e-9


@pytest.mark.parametrize("text", ["I will kill you. " + "word " * 300, "word " * 1500 + "you idiot.", "what an idi0t you are, you i.d.i.o.t", "you idiooot", "you fucking cunt", "an idiot's work, you losers", "YOU M0R0N", "you s-c-u-m"])
def test_toxic_in_any_company(text):
    assert X.judge(text)[0] >= 1


@pytest.mark.parametrize("text", ["one clown " + "word " * 400, "version 1.0.2 of i.e. a b c d e f", "it is 10 o'clock", "!!!!! $$$$$ aaaaa", "the cat sat. " * 3000])
def test_harmless(text):
    assert X.judge(text)[0] < 1


def test_disguises_take_linear_time():
    import time

    for unit in ("a", "a1", "a.", "@", "x ", "aaa ", "1a!"):
        at = time.time()
        X.judge(unit * 500_000)
        assert time.time() - at < 5, unit


def test_special_cases(spark):
    toxic = "you idiot. you moron."
    rows = [(1, None), (2, ""), (3, "  "), (4, toxic), (4, toxic), (None, toxic), (5, "one clown " + "word " * 400), (6, "word " * 100_000 + toxic), (7, (toxic + " ") * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, clauses string")
    got = X.toxic(docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 4, 4, 6, 7]
    assert X.toxic(docs.limit(0)).collect() == []


def test_stems_of_all_languages(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.join(labels, "doc_id")
    odd = labels.where("doc_id % 2 = 1")
    stems = X.learn(docs.drop("toxic", "quality"), odd)
    even = docs.where("doc_id % 2 = 0")
    flagged = {r.doc_id for r in X.toxic(even, stems).collect()}
    rows = even.select("doc_id", "lang", "toxic").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r.doc_id in flagged for r in rows if r.toxic and r.lang == lang]
        assert sum(own) / len(own) > 0.85
    clean = [r.doc_id in flagged for r in rows if not r.toxic]
    assert sum(clean) / len(clean) < 0.005
    assert X.learn(docs.drop("toxic", "quality"), labels.limit(0)) == ()


def test_learning_from_odd_rows(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    text = lambda k: " ".join([word() for _ in range(30)] + ["zorgleth", "zorglein"] * (k % 2))
    rows = [(k, text(k), None, "x") for k in range(120)] + [(None, "zorgleth", "en", "x"), (200, None, None, "x"), (201, "", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic string")
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(120)] + [(None, 1, 1), (200, 1, 1), (201, None, 1), (7, 1, 0)], "doc_id bigint, toxic int, quality int")
    stems = X.learn(docs, labels)
    assert [s for s, _ in stems] == ["zorgle"] and stems == X.learn(docs.drop("lang"), labels)
    both = labels.union(labels.selectExpr("doc_id", "1 - toxic", "quality"))
    assert X.learn(docs, both) == () and X.learn(docs.limit(0), labels) == ()
    assert 0.6 <= stems[0][1] < 1  # few labels: below full severity
    assert X.judge("you Zorglein, zorgle", stems)[0] >= 1 > X.judge("you there", stems)[0]
