"""Model calls as an operator: questions, answers, follow-ups, verdicts.

A client is any callable of messages (a list of {role, content}) to a reply, given
by a factory that runs once a task, on its executor. Calls of a batch overlap in a
thread pool; a reply is retried with growing delays, and what still fails is a row
with its error, not a failed task."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import fill_template, object_in, rounds, uniform
from grainmill.operators.components import ensure_checkpoint_dir
from grainmill.operators.conversations import as_text

Client = Callable[[list[dict]], str]
Factory = Callable[[], Client]


def with_retry(call: Callable[[], str], tries: int = 4, delay: float = 1.0, jitter: Callable[[], float] = lambda: 0.5, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; after each failure but the last a pause of delay * 2^k + jitter."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 == tries:
                raise
            sleep(delay * (2**k + jitter()))
    raise AssertionError


def split_think(reply: str) -> tuple[str, str]:
    """(think, answer) of a reply; see functions.text.think_answer."""
    m = re.search(r"<think>(.*?)</think>(.*)", reply, re.S)
    if m:
        return m.group(1).strip(), m.group(2).strip()
    if "</think>" in reply:
        think, _, rest = reply.partition("</think>")
        return think.strip(), rest.replace("</think>", "").strip()
    return "", reply.replace("<think>", "").strip()


def ask(rows: DataFrame, messages: Column, factory: Factory, out: str = "reply", workers: int = 3, tries: int = 4, delay: float = 1.0) -> DataFrame:
    """rows with `out`: struct<think, answer, error> of the model's reply to messages
    (array<struct<role, content>>), calls of a batch `workers` at a time."""
    kind = pa.struct([(n, pa.string()) for n in ("think", "answer", "error")])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = factory()

        def one(m: list[dict] | None) -> dict | None:
            if m is None:
                return None
            try:
                return dict(zip(("think", "answer"), split_think(with_retry(lambda: client(m), tries, delay)))) | {"error": None}
            except Exception as e:
                return {"think": None, "answer": None, "error": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield pa.array(list(pool.map(one, b.to_pylist())), kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    call = F.arrow_udf(run, "struct<think: string, answer: string, error: string>").asNondeterministic()
    return rows.withColumn(out, call(messages))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def endpoint(key: Column, n: int) -> Column:
    """Which of n endpoints an item uses: by its key, so a rerun asks the same."""
    return F.floor(uniform(key, 1) * n).cast("int")


def verdict(answer: Column, on_parse_error: bool = False) -> Column:
    """struct<is_filter, reason> of a filter's reply; a reply that holds none means on_parse_error."""
    v = F.from_json(object_in(answer), "is_filter boolean, reason string")
    return F.struct(F.coalesce(v.is_filter, F.lit(on_parse_error)).alias("is_filter"), v.reason.alias("reason"))


def score(answer: Column, on_parse_error: float = 0.0) -> Column:
    """struct<score, reason>; 0 drops what can't be parsed, 10 keeps it."""
    v = F.from_json(object_in(answer), "score string, reason string")
    return F.struct(F.coalesce(v.score.try_cast("double"), F.lit(float(on_parse_error))).alias("score"), v.reason.alias("reason"))


def yes(answer: Column) -> Column:
    """A judge's YES or NO."""
    return F.upper(F.trim(answer)) == "YES"


REASONING_TYPES = ("deductive", "inductive", "analogical", "causal")


def reasoning_question(answer: Column, fields: Sequence[str] = ("question", "answer", "type"), types: Sequence[str] = REASONING_TYPES) -> Column:
    """The three fields of an extracted question; null for {} and unknown types."""
    v = F.from_json(object_in(answer), ", ".join(f"{f} string" for f in fields))
    return F.when(v.getField(fields[0]).isNotNull() & v.getField(fields[2]).isin(*types), v)


_MESSAGES = pa.list_(pa.struct([(n, pa.string()) for n in ("role", "content", "think", "answer")]))
_DIALOGUES = "id string, question_no int, task string, messages array<struct<role: string, content: string, think: string, answer: string>>, score double, error string"


def _filled(templates: Mapping[str, str], name: str, **values) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m.group(1), m.group())), templates[name])


def _user(content: str) -> dict:
    return dict(role="user", content=content, think=None, answer=None)


def _assistant(think: str, answer: str) -> dict:
    return dict(role="assistant", content=None, think=think, answer=answer)


def _reply(content: str) -> dict:
    return dict(role="assistant", content=content, think=None, answer=None)


def inline(m: dict) -> str:
    """A message's text, an assistant's reasoning in front of its answer."""
    return f"<think>\n{m['think']}\n</think>\n\n{m['answer']}" if m["answer"] is not None else m["content"] or ""


def numbered(messages: list[dict]) -> str:
    """Question and answer blocks by number; see conversations.as_text."""
    out = []
    for k in range(0, len(messages) - 1, 2):
        u, a = messages[k : k + 2]
        if (u["role"], a["role"]) == ("user", "assistant"):
            n = k // 2 + 1
            out.append(f"Question {n}: {u['content'] or ''}\nAnswer {n}:\nReasoning:\n{a['think'] or ''}\nFinal answer:\n{(a['answer'] if a['answer'] is not None else a['content']) or ''}")
    return "\n".join(out)


def _converse(say, fill, text: str, question: str, asked: str, ask_prompt: str, follow: int, budget: int, count: Callable[[str], int], histories: bool) -> list[tuple[str, list[dict]]]:
    """(task, messages) of one question: its dialogue, and the histories of the models that made it."""
    first = fill("answer", text=text, question=question, history="")
    think, answer = say(first)
    plus = [_user(first), _reply(inline(_assistant(think, answer)))]
    asks, rewrites, talk = [_user(ask_prompt), _reply(asked)], [], []
    used = count(text) + 1000
    for r in range(follow + 1):
        if r:
            history = "\n".join(("Q: " if m["role"] == "user" else "A: ") + inline(m) for m in talk)
            prompt = fill("follow_up", text=text, history=history)
            question = say(prompt)[1]
            think, answer = say(fill("answer", text=text, question=question, history=history))
        mend = fill("rewrite", text=text, answer=answer, think=think)
        think = say(mend)[1]
        size = count(question) + count(answer) + count(think)
        if r and used + size > budget:
            break
        used += size
        talk += [_user(question), _assistant(think, answer)]
        rewrites += [_user(mend), _reply(think)]
        if r:
            asks += [_user(prompt), _reply(question)]
    return [("dialogue", talk)] + ([("max_question", asks), ("max_filter", rewrites), ("plus_answer", plus)] if histories else [])


def _run_items(items: DataFrame, factory: Factory, columns: Sequence[Column], one: Callable[..., list[tuple]], workers: int) -> DataFrame:
    """one(say, *values) for each row, `workers` rows of a task at a time; a row that fails gives one row of task error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        say = lambda prompt: split_think(with_retry(lambda: client([{"role": "user", "content": prompt}])))

        def guarded(values: tuple) -> list[tuple]:
            try:
                return one(say, *values)
            except Exception as e:
                return [(values[0], None, "error", [], None, f"{type(e).__name__}: {e}")]

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                rows = [r for own in pool.map(guarded, zip(*(c.to_pylist() for c in b.columns))) for r in own]
                kinds = (pa.string(), pa.int32(), pa.string(), _MESSAGES, pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "question_no", "task", "messages", "score", "error"])

    return items.select(*columns).mapInArrow(run, _DIALOGUES)


def dialogues(
    items: DataFrame, factory: Factory, prompts: Mapping[str, str], id_col: str = "id", text_col: str = "text", tokens_col: str = "text_length",
    budget: int = 24_500, most_rounds: int = 6, seed: int = 0, count: Callable[[str], int] = lambda t: len(t.split()), workers: int = 3,
) -> DataFrame:
    """(id, question_no, task, messages, score, error): a dialogue for every question about each item.

    A model gives max(1, tokens // 4096) questions; each is answered, the reasoning
    rewritten, and followed up for a number of rounds drawn by the item's id, while
    the running count stays within the budget. Each question has four rows, each
    written once: dialogue; max_question, max_filter and plus_answer are what the
    models were asked and said for the questions, the rewritten reasoning and the
    first answer. An item whose call fails has one row of task error. Items of a task
    run `workers` at a time. prompts: question, answer, follow_up, rewrite with
    {text}, {n}, {question}, {history}, {answer}, {think}."""
    templates = dict(prompts)

    def one(say, key: str, text: str | None, tokens: int | None, follow: int) -> list[tuple]:
        fill = lambda name, **v: _filled(templates, name, **v)
        prompt = fill("question", text=text or "", n=max(1, (tokens or 0) // 4096))
        reply = say(prompt)[1]
        asked = [q.strip() for q in reply.split("\n") if q.strip()]
        if not asked:
            raise ValueError("no question in the reply")
        return [(key, k, task, m, None, None) for k, q in enumerate(asked) for task, m in _converse(say, fill, text or "", q, reply, prompt, follow, budget, count, True)]

    columns = [F.col(id_col).cast("string").alias("id"), F.col(text_col), F.col(tokens_col).cast("int").alias("n"), rounds(F.col(id_col), most_rounds, seed).alias("follow")]
    return _run_items(items, factory, columns, one, workers)


def distil(
    items: DataFrame, factory: Factory, prompts: Mapping[str, str], filters: Sequence[str] = (), id_col: str = "id", text_col: str = "text", tokens_col: str = "text_length",
    messages_col: str | None = None, multi_turn: bool = True, budget: int = 24_500, most_rounds: int = 6, seed: int = 0, over: float = 5, count: Callable[[str], int] = lambda t: len(t.split()), workers: int = 3,
) -> DataFrame:
    """Dialogues with the filters inside the loop; columns as dialogues().

    An item whose messages (messages_col) begin with a user's turn brings its own
    questions: its user turns, which no filter judges. Others are asked for
    questions; with "question_filter" in filters, rejected ones go, but the first
    stays where none would. Each question's dialogue may be rejected by
    "answer_filter", or by "qa_score" at a score of `over` or less: it then has a row
    of task rejected with the reason, and the item's further questions are still
    tried. Without qa_score the score is 10. A verdict that can't be read keeps.
    prompts: also question_filter {question}, answer_filter {qa_pair}, qa_score
    {qa_pair}, {ref_paper}."""
    templates, on = dict(prompts), frozenset(filters)

    def one(say, key: str, text: str | None, tokens: int | None, follow: int, given: list[dict] | None) -> list[tuple]:
        text = text or ""
        fill = lambda name, **v: _filled(templates, name, **v)
        judge = lambda name, **v: parse_object(say(fill(name, **v))[1]) or {}
        prompt = reply = ""
        if given and given[0]["role"] == "user":
            asked = [m["content"] for m in given if m["role"] == "user" and m["content"]]
        else:
            prompt = fill("question", text=text, n=max(1, (tokens or 0) // 4096))
            reply = say(prompt)[1]
            asked = [q.strip() for q in reply.split("\n") if q.strip()]
            if not asked:
                raise ValueError("no question in the reply")
            if "question_filter" in on:
                asked = [q for q in asked if not judge("question_filter", question=q).get("is_filter")] or asked[:1]
        rows = []
        for k, q in enumerate(asked):
            ((_, talk),) = _converse(say, fill, text, q, reply, prompt, follow if multi_turn else 0, budget, count, False)
            score, why = 10.0, None
            if "answer_filter" in on and (v := judge("answer_filter", qa_pair=numbered(talk))).get("is_filter"):
                why = f"answer_filter: {v.get('reason')}"
            elif "qa_score" in on:
                v = judge("qa_score", qa_pair=numbered(talk), ref_paper=text)
                try:
                    score = float(v.get("score", 10))
                except (TypeError, ValueError):
                    score = 10.0
                why = f"qa_score: {v.get('reason')}" if score <= over else None
            rows.append((key, k, "rejected" if why else "dialogue", talk, score, why))
        return rows

    given = F.transform(messages_col, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))) if messages_col else F.lit(None).cast("array<struct<role: string, content: string>>")
    columns = [F.col(id_col).cast("string").alias("id"), F.col(text_col), F.col(tokens_col).cast("int").alias("n"), rounds(F.col(id_col), most_rounds, seed).alias("follow"), given.alias("given")]
    return _run_items(items, factory, columns, one, workers)


def _judged(items: DataFrame, factory: Factory, prompt: Column, out: str, read: Callable[[Column], Column], **how) -> DataFrame:
    asked = ask(items, F.array(message("user", prompt)), factory, "__reply", **how)
    return asked.withColumn(out, read(F.col("__reply.answer"))).withColumn(f"{out}_error", F.col("__reply.error")).drop("__reply")


def question_filter(items: DataFrame, factory: Factory, prompts: Mapping[str, str], out: str = "question_filter", messages: str = "messages", **how) -> DataFrame:
    """items with a model's verdict (struct<is_filter, reason>) on the first message; a
    reply that can't be read keeps; out_error holds a failed call's error."""
    first = F.coalesce(F.get(messages, F.lit(0)).content, F.lit(""))
    return _judged(items, factory, fill_template(prompts["question_filter"], {"question": first}), out, verdict, **how)


def answer_filter(items: DataFrame, factory: Factory, prompts: Mapping[str, str], out: str = "answer_filter", messages: str = "messages", **how) -> DataFrame:
    """As question_filter(), on the whole conversation as text."""
    return _judged(items, factory, fill_template(prompts["answer_filter"], {"qa_pair": as_text(F.col(messages))}), out, verdict, **how)


def qa_score(items: DataFrame, factory: Factory, prompts: Mapping[str, str], out: str = "qa_score", messages: str = "messages", text: str = "text", on_parse_error: float = 0.0, **how) -> DataFrame:
    """items with a model's score (struct<score, reason>) of the conversation beside its text."""
    prompt = fill_template(prompts["qa_score"], {"qa_pair": as_text(F.col(messages)), "ref_paper": F.col(text)})
    return _judged(items, factory, prompt, out, lambda a: score(a, on_parse_error), **how)


def filtered(items: DataFrame, factory: Factory, prompts: Mapping[str, str], filters: Sequence[str] = ("question_filter", "answer_filter", "qa_score"), over: float = 5, **how) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): items that pass the filters in their order, with column score
    where they were scored, and (id, filter, reason, score) of the others. An item is
    asked by a filter only if it passed those before; a failed call rejects."""
    kept, rejects, id_col = items, None, how.pop("id_col", "id")
    ensure_checkpoint_dir(items.sparkSession)  # so no model is asked twice
    for name in filters:
        asked = {"question_filter": question_filter, "answer_filter": answer_filter, "qa_score": qa_score}[name](kept, factory, prompts, **how).checkpoint()
        bad = (F.col(f"{name}.score") <= over) if name == "qa_score" else F.col(f"{name}.is_filter")
        bad = F.coalesce(F.col(f"{name}_error").isNotNull() | bad, F.lit(True))
        value = F.col(f"{name}.score") if name == "qa_score" else F.lit(None).cast("double")
        gone = asked.where(bad).select(F.col(id_col).cast("string").alias("id"), F.lit(name).alias("filter"), F.coalesce(f"{name}_error", f"{name}.reason").alias("reason"), value.alias("score"))
        rejects = gone if rejects is None else rejects.union(gone)
        kept = asked.where(~bad).withColumn("score", value) if name == "qa_score" else asked.where(~bad)
        kept = kept.drop(name, f"{name}_error")
    return kept, rejects


def parse_object(reply: str) -> dict | None:
    """A reply's JSON object outside Spark, mended as functions.text.object_in does; None if there is none."""
    m = re.search(r"\{.*\}", reply, re.S)
    if not m:
        return None
    mended = re.sub(r"""(?<=[{,\[:\s])'([^'"]*)'(?=\s*[:,}\]])""", r'"\1"', re.sub(r",\s*([}\]])", r"\1", m.group()))
    for text in (m.group(), mended):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        return got if isinstance(got, dict) else None
    return None
