"""Quality rules as a ledger of failure bits.

measure() reads each whole text once (an Arrow function) and gives its measurements; ledger() evaluates every rule
once over them and stores a bit for each failure beside the measurements. Policies are versioned bit masks, applied
to the stored bits without reading a text again, and ablations() counts with bitwise aggregation what each rule
rejects alone or with others. Nothing is shuffled but one row of counts for each task.

A null or blank text has no words and fails too_few_words. Long texts are read whole. Equal texts have equal bits; repeated
rows stay and count each; null ids stay null. An empty table gives an empty ledger, and ablations of zeros. Other columns,
whatever their names, are left out of the ledger; filtered() keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, map_batches, text_or_empty, type_of

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_distinct")

#: Rules in order of their bits: name -> failure as a condition on the measurements. A rule is never renumbered.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "upper_case": "n_alpha >= 50 AND 100 * n_upper > 60 * n_alpha",
    "few_distinct_words": "n_words >= 50 AND 100 * n_distinct < 8 * least(n_words, 1000)",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}
BASE = ("too_few_words", "repeated_windows")
#: Versions of the policy: the rules that count in each.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbol_heavy", "duplicate_lines", "upper_case", "few_distinct_words"), "v2": tuple(RULES)}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def repeat_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    pair = ids[:-1] * top + ids[1:]
    if top > 2_000_000:  # so that three words fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:n] * top + ids[2:]
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measures(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()  # at exactly the six ASCII blanks
    row: dict[bytes, int] = {}
    ids = np.fromiter((row.setdefault(w, len(row)) for w in words), dtype=np.int64, count=len(words))
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, text))
    lower = sum(map(str.islower, text))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), n_dup, repeat_words(ids), n_lines, upper, upper + lower, len(row))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements, for every row of df."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([measures(t) for t in b.column(1).to_pylist()], dtype=np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.T)], names=[id_col, *MEASURES])

    return map_batches(df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("text")), run, f"`{id_col}` {type_of(df, id_col)}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(measured: DataFrame) -> DataFrame:
    """measured with fail_bits long: bit i is set if rule i failed."""
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def filtered(df: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of df that pass a version, in one pass: the measurements come beside the row and go again."""

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(m) for m in np.array([measures(t) for t in texts], dtype=np.int64).T]

    return ledger(beside(df, text_col, run, ", ".join(f"{m} long" for m in MEASURES))).where(passes(version)).select("row.*")


def passes(version: str = "v1", bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablations(book: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of the version: rule, n_failed, n_only (rejected by it alone, so kept without it), and n_kept of the version."""
    of = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    names = [r for r in RULES if r in POLICIES[version]]
    sums = []
    for r in names:
        bit = F.lit(mask([r])).cast("long")
        sums += [F.count_if(of.bitwiseAND(bit) != 0).alias(f"failed_{r}"), F.count_if(of == bit).alias(f"only_{r}")]
    one = book.agg(F.count_if(of == 0).alias("n_kept"), *sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only")) for r in names])
    return one.select("n_kept", F.inline(rows)).select("rule", "n_failed", "n_only", "n_kept")
