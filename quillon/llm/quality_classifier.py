"""Quality classifier: ordinal cumulative-link regression over hashed text.

P(grade <= k | x) = sigmoid(threshold_k - w.x): one weight vector over hashed text features is shared by all grades,
the K - 1 thresholds are kept in order by their parameters (the first, then the logarithms of the steps). A row gets
its expected grade and the tail probability P(grade >= k), by which rows are selected.

Grades are the distinct values of the rating column, in order; two of them are the least that tell anything apart (one
threshold). The fit reads MAX_ROWS rated rows at most (the smallest by a hash of the id, so a fixed sample at any size)
and runs on the driver over their sparse features; scoring is one Arrow pass over all rows with the weights as a
broadcast of fixed size (2**BITS floats).

Features are weighted by share, so a long text counts no more than a short one: letters' shape of each word with its
signs, its last two letters, its length, whether it repeats the word before, and how many words were there before. They
are made of whole words of whole texts. Null and empty texts have the bias alone, so equal texts have equal scores.
Ratings that are null are left out; of several ratings of an id the smallest is taken, of several texts the smallest.
Without rated rows, or with one grade, nothing can be told apart: every row gets that grade (null without any) and no tail
probabilities. Repeated rows stay; null ids stay null; an empty table gives no rows. Other columns may have any names;
beside() keeps them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, bounded, labelled_texts, map_batches, text_or_empty, type_of

BITS, MAX_ROWS, STEPS, RATE, RIDGE = 12, 8192, 300, 0.3, 1e-3


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


REPEAT, ALIKE, EMPTY = map(slot, ("repeat", "alike", "empty"))
#: Words that are looked up at a time.
STRETCH = 100_000


LETTERS = re.compile(r"[^\W\d_]+|\d+|(.)\1+", re.S)


def kind_of(run: re.Match) -> str:
    """A run of letters as the kinds of its cases in turn, digits as 9, equal signs as one."""
    text = run[0]
    if run[1] is not None:
        return run[1]
    if not text[0].isalpha():
        return "9"
    return "a" if text.islower() else "A" if text.isupper() else re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" for c in text))


def shape(word: str) -> str:
    """Runs of upper-case letters, other letters and digits as A, a and 9; other characters as they are, runs of one as one."""
    return LETTERS.sub(kind_of, word)


class Features:
    """Slots of words, each word looked at once; the table is bounded and starts again when full."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.row: dict[str, int] = {}
        self.slots = np.empty((most, 3), dtype=np.int32)

    def add(self, word: str) -> int:
        k = self.row[word] = len(self.row)
        size = "s" if len(word) < 3 else "m" if len(word) < 12 else "l" if len(word) < 25 else "x"
        self.slots[k] = slot("s:" + shape(word)), slot("t:" + word[-2:].lower()), slot("z:" + size)
        return k

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of a text: square roots of shares, so that rare signs are heard."""
        words = text.split()
        if not words:
            return np.array([EMPTY], dtype=np.int32), np.ones(1, dtype=np.float32)
        dense = np.zeros(1 << BITS)
        same = distinct = 0
        for k in range(0, len(words), STRETCH):
            part = words[k : k + STRETCH]
            if len(self.row) + len(part) > self.most:
                self.row.clear()
            get, add = self.row.get, self.add
            at = np.fromiter(((add(w) if (i := get(w)) is None else i) for w in part), dtype=np.int64, count=len(part))
            dense += np.bincount(self.slots[at].ravel(), minlength=1 << BITS)
            same += int((at[1:] == at[:-1]).sum()) + (k > 0 and words[k - 1] == words[k])
            distinct = len(np.unique(at))
        if len(words) > STRETCH:  # rows of the table hold within a stretch only
            distinct = len(set(words))
        dense[REPEAT] += same
        dense[ALIKE] += len(words) - distinct
        at = np.flatnonzero(dense)
        return at.astype(np.int32), np.sqrt(dense[at] / len(words)).astype(np.float32)


@dataclass(frozen=True)
class Ordinal:
    """grades ascending; thresholds ascending, one fewer."""

    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Column k: P(grade >= grades[k + 1])."""
        return sigmoid(score[:, None] - self.thresholds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, y: np.ndarray, grades: tuple[float, ...], steps: int = STEPS) -> Ordinal:
    """rows, slots, values: the sparse features; y: grade numbers from 0. Full gradients with Adam; nothing random."""
    k, n = len(grades) - 1, len(y)
    above = np.array([(y > j).mean().clip(1e-3, 1 - 1e-3) for j in range(k)])
    start = -np.log(above / (1 - above))
    p = np.concatenate([np.zeros(1 << BITS), [start[0]], np.log(np.diff(start).clip(1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    lowest, highest = np.r_[-np.inf, np.zeros(k)], np.r_[np.zeros(k), np.inf]
    for t in range(1, steps + 1):
        w, theta = p[: 1 << BITS], np.cumsum(np.r_[p[1 << BITS], np.exp(p[(1 << BITS) + 1 :])])
        highest[:k], lowest[1:] = theta, theta
        score = np.bincount(rows, weights=values * w[slots], minlength=n)
        hi, lo = sigmoid(highest[y] - score), sigmoid(lowest[y] - score)
        inside = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / inside, lo * (1 - lo) / inside
        g_score = (dhi - dlo) / n  # of the mean negative log-likelihood
        g_theta = np.array([(dlo[y == j + 1].sum() - dhi[y == j].sum()) / n for j in range(k)])
        g = np.empty_like(p)
        g[: 1 << BITS] = np.bincount(slots, weights=values * g_score[rows], minlength=1 << BITS) + RIDGE * w
        back = np.cumsum(g_theta[::-1])[::-1]
        g[1 << BITS :] = np.r_[back[0], back[1:] * np.exp(p[(1 << BITS) + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ordinal(grades, p[: 1 << BITS].astype(np.float32), np.cumsum(np.r_[p[1 << BITS], np.exp(p[(1 << BITS) + 1 :])]))


def train(df: DataFrame, ratings: DataFrame, rating_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ordinal:
    """Fit on the texts of df that ratings (id, rating) rates."""
    joined = labelled_texts(df, ratings, F.min(f"`{rating_col}`").cast("double"), max_rows, id_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = list(map(Features().of, b.column(0).to_pylist()))
        return pa.RecordBatch.from_arrays([b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["rating", "slots", "vals"])

    t = map_batches(joined, run, "rating double, slots array<int>, vals array<float>").toArrow()  # max_rows rows at most
    grades, y = np.unique(t["rating"].to_numpy(), return_inverse=True)
    if len(grades) < 2:
        return Ordinal(tuple(grades.tolist()), np.zeros(1 << BITS, dtype=np.float32), np.empty(0))
    lists = [c.combine_chunks() for c in (t["slots"], t["vals"])]
    rows = np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy()))
    return fit(rows, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), y, tuple(grades.tolist()))


def scores(model: Ordinal, table: Features, texts: list[str]) -> list[pa.Array]:
    """Expected grades and tails of texts."""
    found = [table.of(t) for t in texts]
    tails = model.tails(np.array([float(v @ model.weights[s]) for s, v in found]).reshape(-1))
    expected = pa.array(model.grades[0] + tails @ np.diff(model.grades)) if model.grades else pa.nulls(len(texts), pa.float64())
    return [expected, pa.array(list(tails), pa.list_(pa.float64()))]


def score(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade double, tail array<double> (P(grade >= k) from the second grade up) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Features()
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *scores(shared.value, table, b.column(1).to_pylist())], names=[id_col, "expected_grade", "tail"])

    return df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, expected_grade double, tail array<double>")


def selected(df: DataFrame, model: Ordinal, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df whose probability of a grade over the lowest is least or more; all rows if the model tells no grades apart."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size
    table: list[Features] = []  # one in each worker

    def run(texts: list[str]) -> list[pa.Array]:
        if not table:
            table.append(Features())
        return scores(shared.value, table[0], texts)[1:]

    return beside(df, text_col, run, "tail array<double>").where(likely("tail", least)).select("row.*")


def likely(tail: str, least: float) -> Column:
    return F.coalesce(F.try_element_at(tail, F.lit(1)), F.lit(1.0)) >= least
