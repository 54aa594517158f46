"""Scoring: formulas as Python floats for planning and as column expressions for rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Step between the idf of keywords of equal frequency, so that ties are told apart.
TIE = 1e-13


@dataclass(frozen=True)
class Params:
    """alpha: completeness; beta: size; s: length; method: 'damped' (default), 'tuple_average' or 'virtual_document'.

    soft_missing: a keyword that is there is missing in part, by how far its tf and idf are from the largest.
    """

    alpha: float = 2.0
    beta: float = 0.15
    s: float = 0.0115
    method: str = "damped"
    soft_missing: bool = False
    average_size: float = 5.7


def damp(t: float) -> float:
    return 1 + math.log(1 + math.log(t)) if t > 0 else 0.0


def damp_column(t: Column) -> Column:
    return F.when(t > 0, 1 + F.log(1 + F.log(F.greatest(t, F.lit(1)).cast("double")))).otherwise(F.lit(0.0))


def idf(n: int, df: int, k: int = 0) -> float:
    """Negative if over half of the rows have the word; a word of every row counts as of all but half a row."""
    return math.log(max(n - df, 0.5) / df) + TIE * k


def idf_plus_one(n: int, df: int) -> float:
    return math.log(n / (df + 1))


def idf_separate(selectivity: dict[str, float]) -> float:
    """From the smallest selectivity over tables."""
    return math.log(1 / min(selectivity.values()))


def idf_joined(selectivities: list[float]) -> float:
    """Of a joined tree, if tables were independent."""
    rest = math.prod(1 - s for s in selectivities)
    return math.log(1 / max(1 - rest, 1e-300))


def size_weight(nodes: int, nonfree: int, n_keywords: int, p: Params) -> float:
    return (1 + p.beta - p.beta * nodes) * (1 + 1 / (1 + n_keywords) - nonfree / (1 + n_keywords))


def completeness(n_keywords: int, missing: int, p: Params) -> float:
    return n_keywords ** (1 / p.alpha) - missing ** (1 / p.alpha)


def length_weight(dl: Column, avdl: float, p: Params) -> Column:
    return F.lit(1 - p.s) / (F.lit(1 - p.s) + F.lit(p.s) * dl / F.lit(avdl if avdl > 0 else 1.0))


def soft_missing(tfs: list[Column], idfs: list[float], top: list[int], p: Params) -> Column:
    """The alpha-norm of what each keyword lacks of its largest tf and of the largest idf."""
    largest, lacks = max(idfs), F.lit(0.0)
    for tf, i, t in zip(tfs, idfs, top):
        share = i / largest / t if largest > 0 and t else 0.0
        lacks = lacks + F.pow(F.least(F.greatest(F.lit(1.0) - tf * F.lit(share), F.lit(0.0)), F.lit(1.0)), F.lit(p.alpha))
    return F.pow(lacks, F.lit(1 / p.alpha))


def tree_score(tfs: list[Column], idfs: list[float], dl: Column, avdl: float, weight: float, p: Params, top: list[int]) -> Column:
    """(sum of damped tf * idf) * weight * completeness * length. top: the largest tf of each keyword in a row."""
    n = len(tfs)
    local = F.lit(0.0)
    for tf, i in zip(tfs, idfs):
        local = local + damp_column(tf) * F.lit(i)
    missing = F.lit(0)
    for tf in tfs:
        missing = missing + (tf == 0).cast("int")
    lost = soft_missing(tfs, idfs, top, p) if p.soft_missing else F.pow(missing.cast("double"), F.lit(1 / p.alpha))
    whole = F.lit(float(n) ** (1 / p.alpha)) - lost
    return local * F.lit(weight) * whole * length_weight(dl, avdl, p)


def upper_bound(max_tf: list[list[int]], idfs: list[float], weight: float, matched: int, p: Params) -> float:
    """No tree of a network scores over this: max_tf[node][keyword]. Infinite where the weight isn't positive, so that nothing is pruned."""
    if weight <= 0:
        return math.inf
    total = [sum(node[k] for node in max_tf) for k in range(len(idfs))]
    n = len(idfs)
    return weight * completeness(n, n - matched, p) * sum(max(0.0, i) * damp(t) for i, t in zip(idfs, total))
