"""Toxicity by a weighted finite-state pattern grammar.

A clause is read word by word by five deterministic transducers, each reading what the one before it writes: insults and threats
(phrases of any number of words, and single words) write an event for what they match; negation and reported speech
mark the events in their scope; targets join with events near them. A transition that does so carries a weight, by
name: insult, threat, negated, reported, target. The transducers are composed as they are run (Composed), weights add up
along a path, and a clause's score is that of its best event. So a word counts as the clause it stands in makes it
count: "he is not an idiot" weighs less than nothing, "they said: idiot" less than "you idiot". A text's score is the
logistic of its matched clauses' weights, those of one kind by the logarithm of their number.

The weights are fitted together with the bias on labelled rows, ridged towards the grammar's own, under the constraints
that insults, threats and targets never lower a score, reporting never raises one, and a negated event weighs 0 or
less. Insults of one word are learned from the same rows, MAX_ROWS at most (the smallest by a hash of the id): words,
and stems that begin words ("stem*"), that stand in toxic texts in many contexts and hardly in others. Contexts guard
against words of copied texts. Phrases, threats, targets, negations and reports are fixed lists, beside a few insults.
What is learned stands in LEAST_CONTEXTS labelled texts each, so its number is bounded by the sample, not by the corpus.

Null and empty texts match nothing and get the base score. Whole texts are read, and whole clauses, however long. Labels
that are null are left out; of several labels of an id the largest is taken, of several texts the smallest. Without labelled rows the
grammar's own weights hold. Repeated rows stay; null ids stay null; an empty table gives no rows; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, labelled_texts, map_batches, store, text_or_empty, type_of

MAX_ROWS, LEAST_CONTEXTS, LEAST_SHARE = 8192, 6, 0.95
#: Lengths of stems.
STEMS = range(4, 9)

# Words of the classes, and phrases. A phrase may hold an event that was written before it.
INSULTS = frozenset("idiot idiots moron morons imbecile scum loser losers worthless bastard dumbass dickhead scumbag trottel arschloch connard salaud imbécil estúpido".split())
THREATS = frozenset("kill kills hurt murder strangle stab shoot smash burn destroy töten umbringen tuer matar".split())
TARGETS = frozenset("you your you're yourself u he she they them him her these those people du dich dir ihr euch tu toi vous te tú usted ustedes".split())
NEGATIONS = frozenset("not no never don't isn't aren't wasn't won't nicht kein keine nie jamais nunca".split())
REPORTS = frozenset("said says wrote called quoted claimed reported reportedly alleged according sagte dit dijo".split())
INSULT_PHRASES = ("waste of space", "piece of trash", "piece of garbage", "scum of the earth", "good for nothing", "shut up", "get lost", "go to hell", "halt die klappe", "ferme ta gueule", "vete al infierno")
THREAT_PHRASES = ("jump off a bridge", "jump off a cliff", "watch your back", "break your neck", "beat you up", "i will find you", "you will regret", "you will pay for", "hope you die", "drop dead", "insult and die")

#: Weights by name, and the grammar's own; those of reporting and negation are taken off.
ARCS = ("insult", "threat", "target", "reported", "negated")
OWN, BASE = np.array([4.0, 2.5, 1.5, 3.0, 1.0]), -3.5
SCOPE, NEAR = 3, 3
BREAK = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Symbols of words that stand in no phrase.
OTHER, BROKEN = "other", "break"
VOCABULARY = frozenset(w for p in (*INSULT_PHRASES, *THREAT_PHRASES) for w in p.split()) - {"insult"}


@dataclass
class Transducer:
    """Deterministic: step[state, symbol] = (next state, output, names of weights); rest[state] for symbols that aren't listed, which are copied."""

    start: object
    step: dict[tuple[object, str], tuple[object, str, tuple[str, ...]]] = field(default_factory=dict)
    rest: dict[object, object] = field(default_factory=dict)

    def read(self, state: object, symbol: str) -> tuple[object, str, tuple[str, ...]]:
        found = self.step.get((state, symbol))
        return found if found else (self.rest[state], symbol, ())


class Composed:
    """Transducers one after the other, as one deterministic machine whose transitions are made when they are first taken."""

    def __init__(self, parts: list[Transducer]):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.step: dict[tuple[tuple, str], tuple[tuple, str, tuple[str, ...]]] = {}

    def read(self, state: tuple, symbol: str) -> tuple[tuple, str, tuple[str, ...]]:
        found = self.step.get((state, symbol))
        if found is None:
            now, out, names = [], symbol, ()
            for p, s in zip(self.parts, state):
                to, out, more = p.read(s, out)
                now.append(to)
                names += more
            found = self.step[state, symbol] = (tuple(now), out, names)
        return found

    def run(self, symbols: list[str]) -> list[tuple[str, tuple[str, ...]]]:
        """Output and names of weights at each symbol."""
        state, out = self.start, []
        for s in symbols:
            state, o, names = self.read(state, s)
            out.append((o, names))
        return out


def matcher(patterns: list[tuple[str, ...]], event: str) -> Transducer:
    """Writes event, with its weight, in place of the last word of a pattern; states are the longest beginnings of patterns just read."""
    begun = {p[:k] for p in patterns for k in range(len(p))}
    whole, symbols = set(patterns), {s for p in patterns for s in p}
    t = Transducer(())
    for state in begun:
        t.rest[state] = ()
        for s in symbols:
            read = (*state, s)
            if any(read[k:] in whole for k in range(len(read))):
                t.step[state, s] = ((), event, (event,))
            else:
                t.step[state, s] = (next(read[k:] for k in range(len(read) + 1) if read[k:] in begun), s, ())
    return t


def negation(words: frozenset[str] = NEGATIONS) -> Transducer:
    """Marks events within SCOPE words after a negation."""
    t = Transducer(0)
    for left in range(SCOPE + 1):
        t.rest[left] = max(0, left - 1)
        t.step[left, BROKEN] = (0, BROKEN, ())
        for w in ("negation", *words):
            t.step[left, w] = (SCOPE, w, ())
        for e in ("insult", "threat") if left else ():
            t.step[left, e] = (left - 1, f"no_{e}", ("negated",))
    return t


def reported(words: frozenset[str] = REPORTS) -> Transducer:
    """Marks events after a word of reporting, up to the end of the clause."""
    t = Transducer(False)
    for inside in (False, True):
        t.rest[inside] = inside
        t.step[inside, BROKEN] = (False, BROKEN, ())
        for w in ("report", *words):
            t.step[inside, w] = (True, w, ())
        for e in ("insult", "threat", "no_insult", "no_threat") if inside else ():
            t.step[inside, e] = (True, f"said_{e}", ("reported",))
    return t


#: Events as the marks leave them, and the names of the weights on the way to each.
KINDS = {f"{said}{no}{e}": (e, *("negated",) * bool(no), *("reported",) * bool(said)) for e in ("insult", "threat") for no in ("", "no_") for said in ("", "said_")}


def targeted(words: frozenset[str] = TARGETS) -> Transducer:
    """State: words left in which a target before still counts; words left to wait for one behind, and the event that waits. An event that is joined late is written once more, as a whole."""
    t = Transducer((0, 0, ""))
    for since in range(NEAR + 1):
        for wait, kind in [(0, ""), *((w, k) for w in range(1, NEAR + 1) for k in KINDS)]:
            state, less = (since, wait, kind), max(0, since - 1)
            t.rest[state] = (less, wait - 1, kind) if wait > 1 else (less, 0, "")
            t.step[state, BROKEN] = ((0, 0, ""), BROKEN, ())
            for w in ("target", *words):
                t.step[state, w] = ((NEAR, 0, ""), f"late_{kind}" if wait else w, (*KINDS[kind], "target") if wait else ())
            for e in KINDS:
                t.step[state, e] = ((less, 0, "") if since else (0, NEAR, e), e, ("target",) if since else ())
    return t


def grammar(insults: frozenset[str] = INSULTS) -> Composed:
    """insults: words of the vocabulary among them are patterns of one word; others come as the symbol "insult_word"."""
    one = lambda words, name: [(w,) for w in sorted(VOCABULARY & words)] + [(name,)]
    return Composed([
        matcher([*(tuple(p.split()) for p in INSULT_PHRASES), *one(insults, "insult_word")], "insult"),
        matcher([*(tuple(p.split()) for p in THREAT_PHRASES), *one(THREATS, "threat_word")], "threat"),
        negation(), reported(), targeted(),
    ])


#: Kinds of events: the names of their weights, and how often each weight counts. A negated event loses what any event can weigh, and the negation's own.
ALL = [(*KINDS[e], *t) for e in KINDS for t in ((), ("target",))]
ORDER = {frozenset(k): i for i, k in enumerate(ALL)}
SHARES = np.array([[(a in k) * (-1 if a in ("reported", "negated") else 1) - ("negated" in k) * (a in ("insult", "threat", "target")) for a in ARCS] for k in ALL], dtype=float)


@dataclass
class Model:
    insults: frozenset[str]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        lists = ((TARGETS, "target"), (REPORTS, "report"), (NEGATIONS, "negation"), (THREATS, "threat_word"), (self.insults, "insult_word"))
        self.classes = {w: c for ws, c in lists for w in ws} | {w: w for w in VOCABULARY}
        self.machine = grammar(self.insults)
        self.stems = frozenset(w[:-1] for w in self.insults if w.endswith("*"))
        self.kinds = SHARES @ self.weights
        self.trigger = ahocorasick.Automaton()
        phrases = [max(p.split(), key=len) for p in (*INSULT_PHRASES, *THREAT_PHRASES)]
        for w in sorted({*self.insults, *THREATS, *phrases}):
            self.trigger.add_word(w.rstrip("*"), len(w.rstrip("*")))
        self.trigger.make_automaton()

    def symbol(self, word: str) -> str:
        found = self.classes.get(word)
        return found or ("insult_word" if any(word[:n] in self.stems for n in STEMS if n <= len(word)) else OTHER)

    def clause(self, words: list[str]) -> int | None:
        """The kind of a clause's best event."""
        events = [names for out, names in self.machine.run([*map(self.symbol, words), BROKEN]) if names and out != BROKEN]
        return max((ORDER[frozenset(n)] for n in events), key=lambda k: (self.kinds[k], k), default=None)

    def counts(self, text: str) -> np.ndarray:
        """For each kind, the clauses whose best event it is. Only clauses with a word that may begin or end an event are read by the machine; others have none."""
        low, out, done = text.lower(), np.zeros(len(ALL)), 0
        for end, size in self.trigger.iter(low):
            at = end - size + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            first = max(done, max(low.rfind(c, done, at) for c in ".!?;\n") + 1)
            found = BREAK.search(low, end + 1)
            done = found.start() if found else len(low)
            kind = self.clause(WORD.findall(low, first, done))
            if kind is not None:
                out[kind] += 1
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh((self.bias + np.log2(1 + counts) @ self.kinds) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn_insults(sample: DataFrame) -> list[str]:
    """sample: text, label. Words and stems with LEAST_CONTEXTS contexts in toxic texts, LEAST_SHARE of whose texts are toxic."""

    def items(text: str) -> dict[str, int]:
        words, found = WORD.findall(text.lower()), {}
        for k, w in enumerate(words):
            if w not in found:
                found[w] = k
                for n in STEMS:
                    if n < len(w):
                        found.setdefault(w[:n] + "*", k)
        for w, k in found.items():
            found[w] = zlib.crc32(f"{words[k - 1] if k else ''} {words[k][len(w) - 1 :] if w[-1] == '*' else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode("utf-8", "surrogatepass"))
        return found

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        toxic: Counter = Counter()
        other: Counter = Counter()  # their contexts don't matter
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if label:
                toxic.update(items(text).items())
            else:
                other.update(items(text).keys())
        words = [*(w for w, _ in toxic), *other]
        contexts = [*(c for _, c in toxic), *[None] * len(other)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array([*toxic.values(), *other.values()], pa.int64())], names=["word", "context", "n"])

    each = map_batches(sample, run, "word string, context long, n long")
    by_context = each.groupBy("word", "context").agg(F.sum("n").alias("n"))
    toxic = F.coalesce(F.sum(F.when(F.col("context").isNotNull(), F.col("n"))), F.lit(0))
    words = by_context.groupBy("word").agg(F.count("context").alias("contexts"), toxic.alias("toxic"), F.sum("n").alias("n"))
    good = words.where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")) & (F.col("contexts") >= 0.5 * F.col("toxic")))
    return [r.word for r in good.collect()]  # so many labelled texts hold each


def fit(counts: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on the weights and the bias at once, ridged towards the grammar's own; weights are 0 at least (projected Newton steps)."""
    x = np.column_stack([np.log2(1 + counts) @ SHARES, np.ones(len(y))])
    own, pull = np.r_[OWN, BASE], np.r_[np.full(len(OWN), ridge), 0.1]
    low = np.r_[np.zeros(len(OWN)), -np.inf]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - own) ** 2).sum() / 2)

    w = own.copy()
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        g = x.T @ (p - y) + pull * (w - own)
        free = (w > low) | (g < 0)
        h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(pull[free])
        step, size, was = np.zeros(len(w)), 1.0, loss(w)
        step[free] = np.linalg.solve(h, g[free])
        while size > 1e-6 and loss(np.maximum(w - size * step, low)) > was:
            size /= 2
        new = np.maximum(w - size * step, low)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """labels: id, label; the caller leaves out rows that mustn't be learned from."""
    label = (F.max(f"`{label_col}`") > 0).cast("int")
    sample = store(labelled_texts(df, labels.where(F.col(f"`{label_col}`").isNotNull()), label, max_rows, id_col, text_col), "labelled")
    model = Model(INSULTS | frozenset(learn_insults(sample)), OWN, BASE)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = [model.counts(t).tolist() for t in b.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.list_(pa.float64())), b.column(1)], names=["counts", "label"])

    t = map_batches(sample, run, "counts array<double>, label int").toArrow()  # max_rows rows at most
    discard(sample)
    if not len(t):
        return model
    weights, bias = fit(np.array(t["counts"].to_pylist()).reshape(len(t), -1), t["label"].to_numpy())
    return Model(model.insults, weights, bias)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score double, n_clauses long (matched clauses), for every row of df."""
    shared = df.sparkSession.sparkContext.broadcast((model.insults, model.weights, model.bias))  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in bounded(batches):
            counts = np.array([own.counts(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(counts)), pa.array(counts.sum(axis=1).astype(np.int64))], names=[id_col, "score", "n_clauses"])

    return df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, score double, n_clauses long")
