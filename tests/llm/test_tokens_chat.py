"""Token files: exact round trip; chats: marks, masks and escapes."""

import random
import re
from pathlib import Path

import numpy as np

from grainmill.llm import chat as C
from grainmill.llm import tokens as T

ODD = ["", " ", "a", " a", "a ", "a  b", "it's  fine\n\nnow", "x\ty z", "tab\t then", "don't 12 34!?", "é中文 ok", "a b c", "\n", "end\n", "<|endoftext|> <|im_start|>", "word " * 2000, "a　b", "😀 hi".encode("utf-16", "surrogatepass").decode("utf-16")]


def test_word_cache_is_exact():
    own = T.Encoder(T.VOCABULARY)
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice("ab 's\n\t.1é ") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert own.encode(t) == own.ids(t), repr(t)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    own = T.Encoder(T.VOCABULARY)
    t = "one two three four five six one two"
    assert own.encode(t) == own.ids(t) and len(own) <= 3


def test_long_runs_of_any_character():
    own = T.Encoder(T.VOCABULARY)
    for c in (" ", "\n", "a", "1", "!", "\u3000", "中"):
        ids = np.frombuffer(own.encode(c * 1_000_000), own.dtype)
        assert own.encoding.decode(ids.tolist()) == c * 1_000_000
    rng = random.Random(13)
    for _ in range(60):
        t = "".join(rng.choice(("a", " word", "  x", "!")) + rng.choice((" ", "\n", "\t", "\xa0")) * rng.choice((0, 1, 2, 2500)) + rng.choice(("", " ", "\n")) for _ in range(5))
        assert own.encode(t) == np.array(own.encoding.encode_ordinary(t), own.dtype).tobytes()


def test_store_round_trip(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "a"), (99, None)]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id bigint, text string, file string").repartition(3)
    got = T.write_tokens(docs, str(tmp_path / "s")).collect()
    store = T.TokenStore(str(tmp_path / "s"), [r.file for r in got])
    enc = T.encoder(T.VOCABULARY).encoding
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(enc.encode_ordinary(t or ""))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(store.tokens(r.token_start, r.n_tokens).tolist())
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(store) == len(rows)
    assert sorted(store[k].tolist() for k in range(len(store))) == sorted(x for v in want.values() for x in v)
    ends = sorted((r.token_start, r.token_start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert all(o.dtype == np.uint64 for _, o in store.parts)
    assert T.write_tokens(docs.limit(0), str(tmp_path / "e")).collect() == []


def test_escapes_are_undone():
    rng = random.Random(12)
    for _ in range(2000):
        t = "".join(rng.choice(("<|im_end|>", "<", "|", "\\", ">", "a", "<\\|x|>", "<|end-of-text|>", "<|im end|>", "<|" + "n" * 70 + "|>", "<|é|>")) for _ in range(rng.randrange(8)))
        e = C.escape(t)
        assert C.unescape(e) == t
        assert not re.search(r"<\|[^<>]*\|>", e)
    assert C.escape("a <| b |> c <| d") == "a <\\| b |> c <| d"


def test_chats(spark):
    rows = [(1, 2, "assistant", "hello <|im_end|>"), (1, 1, "user", "hi"), (1, 0, None, None), (2, None, "assistant", ""), (2, None, "assistant", ""), (None, 1, "user", "x"), (3, 1, "user", "w " * 50_000), (3, 2, "user", " " * 1_000_000), (4, 1, "<|im_end|>\nx", "hi")]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, mask int")
    got = {r.conv_id: r for r in C.format_chats(conv).collect()}
    assert set(got) == {1, 2, 3, 4}
    enc = T.encoder(T.VOCABULARY).encoding
    begin, end, stop = C.reserved(T.encoder(T.VOCABULARY).size)
    e = enc.encode_ordinary
    body = e("hello <\\|im_end|>")
    head = [begin, *e("\n"), end, begin, *e("user\n"), *e("hi"), end, begin, *e("assistant\n")]
    assert got[1].ids == [*head, *body, end, stop]
    assert got[1].mask == [0] * len(head) + [1] * (len(body) + 1) + [0]
    assert (got[1].n_escaped, got[1].n_turns, got[1].n_trained) == (1, 3, len(body) + 1)
    assert got[2].n_turns == 2 and got[2].n_trained == 2 and sum(got[3].mask) == 0
    assert got[4].ids == [begin, *e("<\\|im_end|> x\n"), *e("hi"), end, stop]
    assert C.format_chats(conv.limit(0)).collect() == []


def by_marks(turns, own):
    """Ids and mask by walking through the turns token by token."""
    begin, end, stop = C.reserved(own.size)
    ids, mask = [], []
    for role, text in turns:
        for part, trained in (([begin], 0), (own.encoding.encode_ordinary(C.escape(" ".join((role or "").split())) + "\n"), 0), (own.encoding.encode_ordinary(C.escape(text or "")), 1), ([end], 1)):
            for t in part:
                ids.append(t)
                mask.append(int(trained and role == "assistant"))
    return ids + [stop], mask + [0]


def test_table_equals_a_walk_by_tokens(spark):
    d = "/root/testdata/sf0.01"
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    talks = {}
    for r in sorted(conv.collect(), key=lambda r: (r.conv_id, r.turn)):
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    own = T.encoder(T.VOCABULARY)
    got = {r.conv_id: (r.ids, r.mask) for r in C.format_chats(conv).collect()}
    assert got == {i: by_marks(t, own) for i, t in talks.items()}


def test_query_of_the_table_round_trips(spark):
    from grainmill.llm import queries
    from grainmill.llm._common import scratch_root

    d = "/root/testdata/sf0.001"
    before = set(Path(scratch_root(spark).removeprefix("file://")).glob("token-files-*"))
    got = queries.op1_token_files(spark, d).collect()
    (folder,) = set(Path(scratch_root(spark).removeprefix("file://")).glob("token-files-*")) - before
    store, own = T.TokenStore(str(folder), [r.file for r in got]), T.encoder(T.VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert store.tokens(r.token_start, r.n_tokens).tolist() == own.encoding.encode_ordinary(texts[r.doc_id])


def test_no_reserved_id_from_text(spark):
    d = "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    size = T.encoder(T.VOCABULARY).size
    for r in C.format_chats(conv).collect():
        ids = np.array(r.ids)
        assert (ids == size + 1).sum() == (ids == size + 2).sum() == r.n_turns and (ids == size).sum() == 1
