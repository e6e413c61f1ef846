"""Conversations: arrays of messages, and operators on them, as expressions.

A message is struct<role, content, think, answer>; arrays keep their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.text import contains_query, inline_think, let, think_headings
from grainmill.operators.components import ensure_checkpoint_dir

MESSAGE = "struct<role: string, content: string, think: string, answer: string>"


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages) from one row a turn, by one shuffle on the key."""
    m = F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content"))
    return turns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))


def content_of(m: Column) -> Column:
    """A message's text: an assistant's think and answer inline, else its content."""
    return F.when((m.role == "assistant") & m.answer.isNotNull(), inline_think(m.think, m.answer)).otherwise(m.content)


def to_sharegpt(items: DataFrame) -> DataFrame:
    """messages with think and answer written into content; other columns as they are."""
    return items.withColumn("messages", F.transform("messages", lambda m: F.struct(m.role.alias("role"), content_of(m).alias("content"))))


def to_labelling(items: DataFrame, key: str = "id", query_source: str = "query_source", answer_source: str = "answer_source") -> DataFrame:
    """(key, prompt, conversation): user turns are sent, others received, empty ones
    skipped; a message's parent is the one before it; ids are digests of key and place."""
    kept = F.filter("messages", lambda m: F.coalesce(m.content, F.lit("")) != "")
    ident = lambda i: F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), i.cast("string")), 256), 1, 32)
    own = items.withColumn("__m", kept)
    made = F.transform(
        "__m",
        lambda m, i: F.struct(
            ident(i).alias("message_id"),
            F.when(m.role == "assistant", think_headings(m.content)).otherwise(m.content).alias("content"),
            F.when(m.role == "user", "send").otherwise("receive").alias("message_type"),
            F.when(m.role == "user", F.col(query_source)).otherwise(F.col(answer_source)).alias("user_id"),
            F.when(i > 0, ident(i - 1)).alias("parent_id"),
        ),
    )
    prompt = F.get(F.transform(F.filter("messages", lambda m: m.role == "user"), lambda m: m.content), F.lit(0))
    return own.select(key, prompt.alias("prompt"), made.alias("conversation"))


def merge_by_first_query(items: DataFrame, key: Column, order: str, messages: str = "messages") -> DataFrame:
    """(query, first, n_records, contents): records with equal first user query as one; the
    first record leads, later ones add the contents that aren't there yet, in order.
    Records without a key are left out."""
    own = items.select(key.alias("query"), F.col(order).alias("o"), F.transform(messages, lambda m: m.content).alias("c")).where("query is not null")
    merged = own.groupBy("query").agg(F.min("o").alias("first"), F.count("*").alias("n_records"), F.array_sort(F.collect_list(F.struct("o", "c"))).alias("all"))
    contents = F.array_distinct(F.filter(F.flatten(F.transform("all", lambda x: x.c)), lambda c: F.coalesce(c, F.lit("")) != ""))
    return merged.select("query", "first", "n_records", contents.alias("contents"))


CUSTOM = ("query_source", "answer_source", "file_path", "source_chunk")


def merge_labelling(items: DataFrame, order: str, messages: str = "messages", key: Column | None = None, prompt: str = "") -> DataFrame:
    """(query, prompt, conversation, custom): labelling records of equal first user
    query (or key) as one. Contents are compared by grouping, so the time grows with
    the turns, however many records a query has; a record is one row in the end.

    Assistants' think blocks become headed sections before contents are compared. The
    record of least `order` gives the custom fields and all its turns that aren't
    empty; later ones add turns whose content isn't there yet. A message's parent is
    the one before it, through all records. Records without a query are left out."""
    own = key if key is not None else first_query(F.col(messages))
    missing = [c for c in CUSTOM if c not in items.columns]
    rows = items.withColumns({c: F.lit("") for c in missing}).withColumn("__q", own).where(F.coalesce(F.col("__q"), F.lit("")) != "")
    shown = lambda m: F.when(m.role == "assistant", think_headings(m.content)).otherwise(m.content)
    turns = F.transform(
        messages,
        lambda m: F.struct(
            shown(m).alias("content"),
            F.when(m.role == "user", "send").otherwise("receive").alias("message_type"),
            F.coalesce(F.when(m.role == "user", F.col("query_source")).otherwise(F.col("answer_source")), F.lit("")).alias("user_id"),
        ),
    )
    custom = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CUSTOM])
    rows = rows.select(F.col("__q").alias("query"), F.struct(F.col(order).alias("o"), F.filter(turns, lambda t: F.coalesce(t.content, F.lit("")) != "").alias("turns"), custom.alias("custom")).alias("r"))
    # a turn is a row until the end: of contents that many records share, one comes through the shuffle
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("r")))
    lead, turn = rows.where("at = 1"), F.posexplode("r.turns").alias("k", "t")
    flat = rows.select("query", "at", turn)
    first = flat.groupBy("query", "t.content").agg(F.min(F.struct("at", "k", "t.message_type", "t.user_id")).alias("x"))
    # the first of a content is kept, and of the leading record all
    later = first.where("x.at > 1").select("query", "x.at", "x.k", F.struct("content", "x.message_type", "x.user_id").alias("t"), F.lit(None).cast(lead.schema["r"].dataType["custom"].dataType).alias("custom"))
    head = lead.select("query", "at", F.posexplode_outer("r.turns").alias("k", "t"), "r.custom")
    kept = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("at", "k", "t"))))
    merged = head.unionByName(later).groupBy("query").agg(F.max("custom").alias("custom"), F.transform(kept, lambda x: x.t).alias("turns"))
    ident = lambda i: F.substring(F.sha2(F.concat_ws("|", F.col("query"), i.cast("string")), 256), 1, 32)
    chain = F.transform("turns", lambda t, i: F.struct(ident(i).alias("message_id"), t.content.alias("content"), t.message_type.alias("message_type"), t.user_id.alias("user_id"), F.when(i > 0, ident(i - 1)).alias("parent_id")))
    return merged.select("query", F.lit(prompt).alias("prompt"), chain.alias("conversation"), "custom")


def first_query(messages: Column) -> Column:
    return F.get(F.transform(F.filter(messages, lambda m: m.role == "user"), lambda m: m.content), F.lit(0))


def pair_turns(messages: Column, strict: bool = False) -> Column:
    """array<struct<question, answer>>: the i-th user turn with the i-th assistant
    turn; strict: positions 2i and 2i + 1, if their roles are these."""
    if strict:
        n = F.size(messages)
        at = F.when(n >= 2, F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        pairs = F.transform(at, lambda i: F.struct(F.get(messages, i * 2).alias("u"), F.get(messages, i * 2 + 1).alias("a")))
        ok = F.filter(pairs, lambda p: (p.u.role == "user") & (p.a.role == "assistant"))
        return F.transform(ok, lambda p: F.struct(p.u.content.alias("question"), p.a.content.alias("answer")))
    side = lambda r: F.transform(F.filter(messages, lambda m: m.role == r), lambda m: m.content)
    none = F.array().cast("array<int>")

    def zipped(s: Column) -> Column:
        n = F.least(F.size(s.u), F.size(s.a))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none), lambda i: F.struct(F.get(s.u, i).alias("question"), F.get(s.a, i).alias("answer")))

    return let(F.struct(side("user").alias("u"), side("assistant").alias("a")), zipped)


def as_text(messages: Column, number: str = "Question", reply: str = "Answer", think: str = "Reasoning:", answer: str = "Final answer:") -> Column:
    """Numbered question and answer blocks with the reasoning, of the messages at 2i
    and 2i + 1 whose roles are user and assistant; the labels are parameters."""
    n = F.floor(F.size(messages) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct((i + 1).cast("string").alias("n"), F.get(messages, i * 2).alias("u"), F.get(messages, i * 2 + 1).alias("a")))
    own = F.filter(pairs, lambda p: (p.u.role == "user") & (p.a.role == "assistant"))
    text = lambda c: F.coalesce(c, F.lit(""))
    block = lambda p: F.concat(F.lit(f"{number} "), p.n, F.lit(": "), text(p.u.content), F.lit(f"\n{reply} "), p.n, F.lit(f":\n{think}\n"), text(p.a.think), F.lit(f"\n{answer}\n"), text(F.coalesce(p.a.answer, p.a.content)))
    return F.array_join(F.transform(own, block), "\n")


def history(messages: Column) -> Column:
    """Q: and A: lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.when(m.role == "user", "Q: ").otherwise("A: "), F.coalesce(m.content, F.lit("")))), "\n")


def as_markdown(messages: Column) -> Column:
    """A document with numbered questions and answers; an answer ends a round."""
    head = lambda m, i: F.when(m.role == "user", F.concat(F.lit("## Question "), F.get(numbers, i).cast("string"))).otherwise(F.concat(F.lit("## Answer "), F.get(numbers, i).cast("string")))
    index = F.sequence(F.lit(0), F.size(messages) - 1)
    numbers = F.transform(index, lambda i: F.size(F.filter(F.slice(messages, F.lit(1), i), lambda m: m.role == "assistant")) + 1)
    return F.when(F.size(messages) > 0, F.array_join(F.transform(messages, lambda m, i: F.concat(head(m, i), F.lit("\n\n"), F.coalesce(m.content, F.lit("")))), "\n\n")).otherwise("")


def add_question(messages: Column, question: str, most: int = 10) -> Column:
    """Appends a user turn, unless there are `most` of them."""
    n = F.size(F.filter(messages, lambda m: m.role == "user"))
    return F.when(n < most, F.array_append(messages, F.struct(F.lit("user").alias("role"), F.lit(question).alias("content")))).otherwise(messages)


def parent_chain(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each turn with the place of the one before it, null for the first."""
    return turns.withColumn("parent", F.lag(order).over(Window.partitionBy(key).orderBy(order)))


def number_rounds(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """round: 1 + the assistant turns before this one."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("round", F.coalesce(F.count_if(F.col("role") == "assistant").over(before), F.lit(0)) + 1)


def resume(items: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Items without a result yet; a missing id counts as the empty one on both sides."""
    ids = done.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id")).distinct()
    return items.join(ids, F.coalesce(F.col(id_col).cast("string"), F.lit("")) == F.col("__id"), "left_anti")


def search(rows: DataFrame, query: str, text: str = "text", deleted: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows that contain the query and aren't deleted; an empty query keeps all."""
    if deleted is not None:
        rows = rows.join(deleted.select(id_col).distinct(), id_col, "left_anti")
    return rows.where(contains_query(F.col(text), query)) if query.strip() else rows


def _placed(rows: DataFrame, id_col: str, around: bool) -> DataFrame:
    """Numbers and neighbours without sorting the table in one task: ranges are sorted
    side by side, and the few ranges' counts and ends say what lies across their edges."""
    ensure_checkpoint_dir(rows.sparkSession)
    parts = rows.sparkSession.sparkContext.defaultParallelism
    own = rows.select(F.col(id_col).alias("i")).where("i is not null").repartitionByRange(parts, "i").withColumn("p", F.spark_partition_id())
    own = own.checkpoint()  # range bounds are sampled: keep one run's
    w, edge = Window.partitionBy("p").orderBy("i"), Window.orderBy("p")
    whole = edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = own.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    ends = ends.select("p", (F.sum("n").over(edge) - F.col("n")).alias("base"), F.lead("lo").over(edge).alias("after"), F.lag("hi").over(edge).alias("before"), F.min("lo").over(whole).alias("least"), F.max("hi").over(whole).alias("most"))
    near = own.select("i", "p", F.row_number().over(w).alias("k"), F.lead("i").over(w).alias("next"), F.lag("i").over(w).alias("last")).join(F.broadcast(ends), "p")
    last = (F.col("least"), F.col("most")) if around else (F.lit(None), F.lit(None))
    return near.select(F.col("i").alias(id_col), (F.col("base") + F.col("k")).cast("bigint").alias("position"), F.coalesce("next", "after", last[0]).alias("next_id"), F.coalesce("last", "before", last[1]).alias("previous_id"))


def neighbours(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, position, next_id, previous_id) through the surviving rows, around the ends; null ids are left out."""
    return _placed(rows, id_col, True)


def bounded_neighbours(rows: DataFrame, id_col: str) -> DataFrame:
    """As neighbours(), but stopping at the ends."""
    return _placed(rows, id_col, False)


def above_score(items: DataFrame, score: str = "score", over: float = 5) -> DataFrame:
    return items.where(F.col(score) > over)


def accepted(items: DataFrame, verdicts: list[str]) -> DataFrame:
    """Items no verdict column (struct with is_filter) rejects; null doesn't reject."""
    for v in verdicts:
        items = items.where(~F.coalesce(F.col(f"{v}.is_filter"), F.lit(False)))
    return items


def without_user_turn(items: DataFrame) -> DataFrame:
    """Items that have a message, and one of the user's."""
    return items.where(F.exists("messages", lambda m: m.role == "user"))


def prioritise(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns first, in that order, those that exist; then the others."""
    own = [c for c in first if c in df.columns]
    return df.select(*own, *[c for c in df.columns if c not in own])
