"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat verb, target, negation, reporting verb,
intention, other). Five sequential transducers rewrite the class string of a
clause and weight it; they are composed, once, into one machine:

* target: an insult after "you" is aimed at the reader, after a pronoun or a
  determiner at someone, else it is bare;
* threat: intention + threat verb + target, or threat verb + "you", is a threat;
* negation: insults and threats up to four words behind a negation are denied;
* reported speech: those behind a reporting verb are somebody else's words;
* weights: what each remaining symbol adds to the clause's score.

A clause ends at . ! ? ; : or a line's end. A clause without an insult or a
threat verb scores 0 in this machine whatever else it says, so only clauses
that hold one are run; an Aho-Corasick automaton finds them.

Words are read through common disguises: a letter said three times or more
("idiooot"), digits and signs for letters ("idi0t"), letters set apart by signs
or spaces ("i.d.i.o.t"). What is so undone has the length it had, so positions
stay. A word the lists don't know is read by its parts at apostrophes
("l'imbécile", "idiot's").

The word lists know only the words in them. Word stems of each language are
learned besides from labelled texts (learn): beginnings of words that make far
more of the words of toxic texts than of others. A word that begins with one is
an insult to the grammar. Learning takes a sample of LEARN_ROWS labelled texts
at most for each language and label, those of least hash.

A document's score is that of its worst passage: the greatest sum of the clauses
that lie within SPAN characters (a longer clause is a passage by itself), over
ENOUGH. It is toxic from a score of 1. One threat or one insult aimed at the
reader is enough; of bare words it takes several in a passage. What else the
text holds, before or after, doesn't matter.

Results for special cases:
* null, empty or blank text: score 0, not toxic;
* null doc_id and repeated rows: judged like any other row;
* no labels, or fewer than LEAST toxic texts with a stem: no stem is learned;
* a doc_id labelled both ways: not learned from; null lang, or no such column: a language;
* ties: a score of exactly 1 is toxic;
* very long texts: judged whole; an empty table gives an empty result;
* positions are those in the lower-case text;
* other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm._common import broadcast_ids

SPAN, ENOUGH = 600, 1.55

_WORDS = {
    "INS": """idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins dumbass dumbasses loser losers scum clown clowns
        trash garbage vermin pathetic worthless stupid disgusting dumb retard retards retarded asshole assholes bastard bastards bitch
        bitches whore whores slut sluts pig swine dickhead dickheads jackass scumbag scumbags filth fuck fucker fuckers fucking cunt cunts
        idioten trottel arschloch dummkopf abschaum versager wertlos erbärmlich widerlich schwachkopf
        imbécile imbéciles crétin crétins connard connards connasse salaud abruti ordure minable débile dégoûtant
        idiota idiotas imbécil estúpido estúpida basura escoria inútil patético asqueroso cabrón gilipollas""",
    "THR": """kill murder hurt destroy stab shoot strangle beat smash hang burn töten umbringen erschießen vernichten verprügeln
        tuer frapper égorger brûler matar golpear destruir apuñalar""",
    "YOU": "you your yours you're youre ya u du dich dir ihr euch tu te toi vous usted ustedes tú ti",
    "AIM": """he she they him them his her their it this that these those the such er sie dieser diese dieses der die das
        il elle ils elles ce cet cette ces le la les él ella ellos ellas ese esa este esta el los las""",
    "NEG": """not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot
        nicht kein keine keinen nie niemals pas jamais aucun sans nunca jamás tampoco sin""",
    "REP": """said says say saying told tells wrote writes claimed claims called calls calling quoted quotes reported reports alleged allegedly
        sagte sagt schrieb behauptete nannte dit disait écrit affirmé appelé dijo dice escribió afirmó llamó""",
    "INT": "will i'll we'll gonna going shall must would want wanna werde werden wirst vais allons voy vamos",
}
CLASSES = ("OTH", "INS", "THR", "YOU", "AIM", "NEG", "REP", "INT")
#: The harder words of the insult class; all others weigh 1.
_SEVERITY = {"scum": 1.1, "vermin": 1.3, "filth": 1.2, "abschaum": 1.2, "escoria": 1.2, "dumb": 0.8, "pig": 0.7, "trash": 0.9, "garbage": 0.7, "stupid": 0.9}
_WEIGHT = {"INS_YOU": 1.6, "INS_AIM": 1.15, "INS_BARE": 1.0, "THREAT": 2.6, "WEAK": 2.0}
_DENIED, _REPORTED = 0.15, 0.35
#: Learning: rows a language and label, and their characters; lengths of stems; a stem's least texts and share of the toxic ones, times as frequent, and log-likelihood ratio.
LEARN_ROWS, LEARN_CHARS, LENGTHS = 1000, 20_000, range(3, 9)
LEAST, SHARE, TIMES, EVIDENCE = 4, 0.05, 10, 15
#: The part of a stem's words that a longer one must have to replace it; how many times as frequent a stem of full severity is.
MOST, SURE = 0.75, 300

#: Learned stems and their severity.
Stems = tuple[tuple[str, float], ...]
#: state -> symbol in -> (symbol out, weight, next state)
Sequential = dict[object, dict[str, tuple[str, float, object]]]


def _machine(states: list, symbols: tuple[str, ...], step) -> Sequential:
    return {s: {a: step(s, a) for a in symbols} for s in states}


def compose(first: Sequential, second: Sequential, start=(0, 0)) -> Sequential:
    """The transducer that runs first and feeds what it puts out to second."""
    out: Sequential = {}
    todo = [start]
    while todo:
        s = todo.pop()
        if s in out:
            continue
        out[s] = {}
        for a, (b, w, n) in first[s[0]].items():
            c, v, m = second[s[1]][b]
            out[s][a] = (c, w * v, (n, m))
            todo.append((n, m))
    return out


def _target() -> Sequential:
    def step(s, a):
        kind, left = s or ("", 0)
        if a == "INS":
            return {"YOU": "INS_YOU", "AIM": "INS_AIM", "": "INS_BARE"}[kind], 1.0, s
        if a in ("YOU", "AIM"):
            return a, 1.0, (a, 4 if a == "YOU" else 2)
        return a, 1.0, (kind, left - 1) if left > 1 else 0

    return _machine([0, *[("YOU", k) for k in range(1, 5)], *[("AIM", k) for k in range(1, 3)]], CLASSES, step)


_AIMED = ("OTH", "INS_YOU", "INS_AIM", "INS_BARE", "THR", "YOU", "AIM", "NEG", "REP", "INT")


def _threat() -> Sequential:
    """States: 0; meant (k words left); hit (a threat verb was said; with or without intention)."""

    def step(s, a):
        kind, left = s or ("", 0)
        if a == "INT":
            return a, 1.0, ("meant", 3)
        if a == "THR":
            return a, 1.0, ("hit", 3) if kind == "meant" else ("said", 1)
        if kind == "hit" and a in ("YOU", "AIM"):
            return "THREAT", 1.0, 0
        if kind == "said" and a == "YOU":
            return "WEAK", 1.0, 0
        return a, 1.0, (kind, left - 1) if left > 1 else 0

    return _machine([0, *[(n, k) for n in ("meant", "hit") for k in (1, 2, 3)], ("said", 1)], _AIMED, step)


_FOUND = (*_AIMED, "THREAT", "WEAK")


def _negation() -> Sequential:
    def step(s, a):
        if a == "NEG":
            return a, 1.0, 4
        return a, _DENIED if s and a in _WEIGHT else 1.0, max(0, s - 1)

    return _machine(list(range(5)), _FOUND, step)


def _reported() -> Sequential:
    return _machine([0, 1], _FOUND, lambda s, a: (a, _REPORTED if s and a in _WEIGHT else 1.0, int(s or a == "REP")))


def _weights() -> Sequential:
    return _machine([0], _FOUND, lambda s, a: (a if a in _WEIGHT else "", _WEIGHT.get(a, 0.0), 0))


@lru_cache(1)
def grammar() -> tuple[list[list[int]], list[list[float]], list[list[str]]]:
    """The composed machine as tables by state and class: next state, weight, label."""
    t: Sequential = _target()
    for x in (_threat(), _negation(), _reported(), _weights()):
        t = compose(t, x, (next(iter(t)), 0))
    at = {s: k for k, s in enumerate(t)}
    start = next(iter(t))
    assert at[start] == 0
    cell = [[t[s][a] for a in CLASSES] for s in t]
    return [[at[c[2]] for c in row] for row in cell], [[c[1] for c in row] for row in cell], [[c[0] for c in row] for row in cell]


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Where a disguise may be: a digit or sign among letters, letters set apart (a quick form and the whole one).
_SIGN = re.compile(r"[0-9@$*!|](?<=[^\W\d_].)(?=[^\W\d_])")
_APART = re.compile(r"[.*_ -]\w[.*_ -]\w[.*_ -]")
_SPELLED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[.*_ -][^\W\d_](?![^\W\d_])){3,}")
_INNER, _EDGE = re.compile(r"[^\W]|[@$*!|]"), re.compile(r"[^\w@$*!|]")
_LEET = str.maketrans("01345789@$!|", "oieastbgasil")
_RUN = re.compile(r"(.)\1\1+")


def stems_of(toxic_texts: list[str], others: list[str]) -> dict[str, float]:
    """Beginnings of words that tell toxic texts of a language from others, and their
    severity; a text's equal words count once."""

    def count(texts: list[str]) -> tuple[Counter, Counter, int]:
        words, within, total = Counter(), Counter(), 0
        for t in texts:
            own = set(_TOKEN.findall(t.lower()))
            stems = [w[:n] for w in own for n in LENGTHS if len(w) >= n]
            words.update(stems)
            within.update(set(stems))
            total += len(own)
        return words, within, total

    apart: list[tuple[str, int]] = []
    holds: dict[str, list[int]] = {}
    for t in toxic_texts:  # near copies are evidence once
        own = {w for w in _TOKEN.findall(t.lower()) if len(w) > 5}
        shared = Counter(k for w in own for k in holds.get(w, ()))
        if not any(2 * n > min(len(own), apart[k][1]) for k, n in shared.items()):
            for w in own:
                holds.setdefault(w, []).append(len(apart))
            apart.append((t, len(own)))
    toxic_texts = [t for t, _ in apart]
    (hot, within, n), (cold, _, m) = count(toxic_texts), count(others)
    if not m:
        return {}
    found = []
    for stem, k in hot.items():
        expected = (cold[stem] + 0.5) / m * n
        if within[stem] >= max(LEAST, SHARE * len(toxic_texts)) and k >= TIMES * expected and (evidence := k * math.log(k / expected) - k + expected) >= EVIDENCE:
            found.append((-evidence, -len(stem), stem))
    out: dict[str, float] = {}
    for _, _, stem in sorted(found):
        # as long a beginning as most of its words have
        own = max((x for x in hot if x.startswith(stem) and hot[x] >= MOST * hot[stem]), key=lambda x: (len(x), hot[x], x))
        if not any(own.startswith(x) or x.startswith(own) for x in out):
            times = hot[own] * m / ((cold[own] + 0.5) * n)
            out[own] = round(min(1.0, 0.6 + 0.4 * math.log(max(1.0, times / TIMES)) / math.log(SURE / TIMES)), 3)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Stems:
    """The stems of all languages of the labelled documents, with their severity."""
    y = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most")
    )
    lang = (F.col("lang") if "lang" in docs.columns else F.lit("")).cast("string").alias("lang")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang, "text").where(F.length("text").between(1, LEARN_CHARS))
    by = Window.partitionBy("lang", "y").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = {r.doc_id: r.y for r in own.select("doc_id", "lang").join(y, "doc_id").withColumn("k", F.row_number().over(by)).where(F.col("k") <= LEARN_ROWS).select("doc_id", "y").collect()}
    texts: dict[str, tuple[list[str], list[str]]] = {}
    for lang, i, text in sorted({(r.lang or "", r.doc_id, r.text) for r in broadcast_ids(own, list(picked)).collect()} if picked else ()):
        texts.setdefault(lang, ([], []))[1 - picked[i]].append(text)
    out: dict[str, float] = {}
    for a, b in texts.values():
        for x, w in stems_of(a, b).items():
            out[x] = max(w, out.get(x, 0.0))
    return tuple(sorted(out.items()))


@lru_cache(4)
def _lexicon(stems: Stems = ()):
    """Classes by word, the automaton of insults, threat verbs and stems, clause edges, stems and their lengths."""
    import ahocorasick

    words: dict[str, int] = {}
    for name, own in _WORDS.items():
        for w in own.split():
            words.setdefault(w, CLASSES.index(name))
    triggers = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w, c in words.items():
        if CLASSES[c] in ("INS", "THR"):
            triggers.add_word(w)
    for x, _ in stems:
        triggers.add_word(x)
    triggers.make_automaton()
    return words, triggers, re.compile(r"[.!?;:\n\r\u2028\u2029]"), dict(stems), sorted({len(x) for x, _ in stems}, reverse=True)


def _undone(word: str, words: dict[str, int]) -> str | None:
    """The insult or threat verb that a disguised word stands for."""
    for w in (word, word.strip("!|*$@")):
        for own in (w, _RUN.sub(r"\1\1", w), _RUN.sub(r"\1", w)):
            for x in (own, own.translate(_LEET)):
                if words.get(x) in (1, 2):
                    return x
    return None


def _odd(text: str) -> list[tuple[int, bool]]:
    """Places of text, in lower case, where a disguise may be, and whether letters are set apart there."""
    found = [(m.start(), False) for m in _SIGN.finditer(text)]
    found += [(m.start() - 1, True) for m in _APART.finditer(f" {text} ")]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = c[1:] == c[:-1]
    last = c[2:]
    runs = np.flatnonzero(same[1:] & same[:-1] & ((last >= 97) & (last <= 122) | (last >= 0xB5)))
    found += [(k, False) for k in runs[np.diff(runs, prepend=-2) > 1].tolist()]  # a letter three times and more
    return sorted(found)


def plain(text: str, words: dict[str, int]) -> str:
    """text, in lower case, with disguised words of the lists undone and filled up with spaces."""
    parts, at = [], 0
    for place, apart in _odd(text):
        if place < at and not apart:
            continue
        if apart:
            m = next((m for k in (place - 1, place, place + 1) if k >= at and (m := _SPELLED.match(text, k))), None)
            if not m:
                continue
            begin, end, word = m.start(), m.end(), m.group()[::2]
        else:
            begin = place
            while begin > at and _INNER.match(text[begin - 1]):
                begin -= 1
            edge = _EDGE.search(text, place)
            end = edge.start() if edge else len(text)
            word = text[begin:end]
        known = _undone(word, words)
        parts += [text[at:begin], known.ljust(end - begin) if known else text[begin:end]]
        at = end
    return "".join(parts) + text[at:] if parts else text


def clause_score(clause: str, stems: Stems = ()) -> tuple[float, str]:
    """The score of a clause, and the labels of what matched in it."""
    words, _, _, begins, lengths = _lexicon(stems)
    nxt, weight, label = grammar()
    s, total, labels = 0, 0.0, []

    def known(w: str) -> tuple[int, float]:
        """Class and severity; a word of no list may begin with a stem."""
        if c := words.get(w):
            return c, _SEVERITY.get(w, 1.0)
        stem = next((w[:n] for n in lengths if w[:n] in begins), None)
        return (0, 1.0) if stem is None else (1, begins[stem])

    own: list[tuple[int, float]] = []
    for w in _TOKEN.findall(clause.lower().replace("’", "'")):
        if (k := known(w))[0] or "'" not in w:
            own.append(k)
        else:
            own += map(known, w.split("'"))
    for c, hard in own:
        if weight[s][c]:
            total += weight[s][c] * hard
            labels.append(label[s][c])
        s = nxt[s][c]
    return total, "+".join(labels)


def clauses(text: str, stems: Stems = ()) -> list[tuple[int, int, str, float]]:
    """(start, end, labels, score) of the clauses of text that match."""
    words, triggers, edge, begins, _ = _lexicon(stems)
    text, out, end = plain(text.lower(), words), [], 0
    for last, n in triggers.iter(text):
        start, stop = last + 1 - n, last + 1
        if start < end or text[start - 1 : start].isalnum() or text[stop : stop + 1].isalnum() and text[start:stop] not in begins:
            continue
        after = edge.search(text, stop)
        # the clause begins behind the last edge before the match
        begin = max(end, max(text.rfind(c, end, start) for c in ".!?;:\n\r\u2028\u2029") + 1)
        end = after.start() if after else len(text)
        score, labels = clause_score(text[begin:end], stems)
        if score:
            out.append((begin, end, labels, score))
    return out


def judge(text: str | None, stems: Stems = ()) -> tuple[float, list[tuple[int, int, str, float]]]:
    found = clauses(text, stems) if text else []
    worst = held = 0.0
    first = 0
    for k, (_, stop, _, score) in enumerate(found):
        held += score
        while first < k and stop - found[first][0] > SPAN:
            held -= found[first][3]
            first += 1
        held = score if first == k else held
        worst = max(worst, held)
    return worst / ENOUGH, found


_SCHEMA = "doc_id bigint, score double, clauses array<struct<start: int, stop: int, labels: string, score: double>>"


def _flag(stems: Stems):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("labels", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), [judge(t, stems) for t in batch.column(1).to_pylist()]
            rows = [(i, s, [dict(zip(("start", "stop", "labels", "score"), c)) for c in cs]) for i, (s, cs) in zip(ids, found) if s >= 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)], names=["doc_id", "score", "clauses"])

    return run


def toxic(docs: DataFrame, stems: Stems = ()) -> DataFrame:
    """(doc_id, score, clauses) of the toxic documents, with their matched clauses."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_flag(stems), _SCHEMA)


def keeper(stems: Stems = ()):
    """For _common.keep_rows: texts that aren't toxic stay."""
    return lambda texts: [judge(t, stems)[0] < 1 for t in texts]
