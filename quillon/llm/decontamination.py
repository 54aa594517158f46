"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark text of m characters that stands in a document with at most k edits shares m - q + 1 - k q of its q-grams
with it, all within k diagonals (document position less benchmark position). So: hash the q-grams of documents, look
them up in an index of the benchmark's, count hits for each target and overlapping diagonal band (two bands cover each
hit, so a range of k diagonals is whole in one), retain bands that reach the bound, and verify by alignment within the
band. Nothing is sampled: a band below the bound can't hold a match.

Of a benchmark text of over WINDOW characters each part of WINDOW characters is looked for, wherever it begins: hits are
counted for overlapping stretches of 2 WINDOW, one of which holds the part whole, and within the bands that reach the
part's bound the parts on a grid are aligned first, then those at every offset. Up to 1.25 WINDOW the whole text is
looked for as well, with its own edits. Texts are compared lower-cased, with every run of signs and white space as one
space.

Hits are expanded in slices of at most SLICE postings: of positions (a band's hits stand within one target's length of each
other), and where those of few positions are still too many, as of a passage that many items share, of targets. So a
worker's memory doesn't depend on how often a passage stands in the benchmark or in a text, and no gram is left out.

Documents aren't shuffled. Items are normalised and cut into overlapping pieces by Spark first, so that no item is too long
for a part of the index; parts of PART_CHARS are broadcast and scanned one after the other. decontaminated() writes
the rows that are left between parts, so that a worker holds one part at a time.

Items under MIN_CHARS (normalised) match exactly and at word bounds only, so an item of one word matches each text that
holds the word; where that isn't wanted, the caller leaves such items out. Null and empty items match nothing.
Null and empty texts match nothing; long ones are read whole. All passages of an item in a text that don't overlap are found.
Repeated rows give repeated matches; of items with equal ids each different text counts by itself, equal ones once. An
empty table on either side gives no rows. Other columns, whatever their names, are left out by contaminated() and kept by
decontaminated().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import beside, bounded, discard, store, text_or_empty, type_of

Q, EDITS, WINDOW, MIN_CHARS = 8, 0.1, 160, 40
#: Most characters of a broadcast part of the benchmark (on average; pieces of items are PIECE at most), and of documents that are scanned at a time.
PART_CHARS, PIECE, CHUNK = 8_000_000, 100_000, 1 << 19
#: Most postings that are expanded at a time.
SLICE = 1 << 19
#: Bits of the table of hashes and of the tally; what is added to diagonals so that none is negative.
SLOTS, TALLY, SHIFT = 22, 19, 1 << 20
#: Zeros on either side of the text to align; most parts that are aligned at a time; half the step of the coarse offsets.
PAD, ROWS, SLACK = 1024, 4096, 8
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = np.zeros(0x3100, dtype=bool)
WORD[0x80:] = True
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
WORD[[*range(0x80, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, 0x1680, *range(0x2000, 0x2070), *range(0x3000, 0x3030)]] = False


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and for each its position in text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = WORD[np.minimum(code, len(WORD) - 1)]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word[at], code[at], 32).astype(np.uint32), at


def as_text(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash for each q-gram, q a power of 2, by doubling."""
    h, base, n = code.astype(np.uint64), MIX | np.uint64(1), 1
    with np.errstate(over="ignore"):
        while n < q:
            h = h[:-n] * base + h[n:]
            base *= base
            n *= 2
        h ^= h >> np.uint64(29)
        return h * MIX


@dataclass
class Index:
    """Targets (stretches of items) one after the other in code, each sought in parts of a length of its own; postings (target, its step, position in it) by hash, then target; place is both as one number."""

    code: np.ndarray
    start: np.ndarray
    size: np.ndarray
    part: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    item: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    target: np.ndarray
    offset: np.ndarray
    step: np.ndarray
    place: np.ndarray
    flags: np.ndarray
    short: dict[str, list[int]]

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for text in self.short:
            out.add_word(text, text)
        out.make_automaton()
        return out


def stretches(n: int) -> list[tuple[int, int, int]]:
    """Begin and end of a text's stretches and the length of the parts to look for in each: every part of WINDOW is whole in one."""
    whole = [(0, n, n)] if n <= WINDOW + WINDOW // 4 else []
    return whole + [(s, min(s + 2 * WINDOW, n), WINDOW) for s in range(0, n - WINDOW, WINDOW)]


def index_of(items: list[str | None], q: int = Q) -> Index:
    codes, owners, parts, short = [], [], [], {}
    for k, text in enumerate(items):
        code = normalised(text or "")[0]
        code = code[:-1] if len(code) and code[-1] == 32 else code
        if len(code) >= MIN_CHARS:
            for a, b, part in stretches(len(code)):
                codes.append(code[a:b])
                owners.append(k)
                parts.append(part)
        elif len(code):
            short.setdefault(as_text(code), []).append(k)
    size, part = np.array([len(c) for c in codes], dtype=np.int64), np.array(parts, dtype=np.int64)
    edits = np.minimum((EDITS * part).astype(np.int64), (part - q) // q)  # the bound stays 1 at least
    start = np.r_[0, np.cumsum(size)].astype(np.int64)
    flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    where = np.concatenate([np.arange(s, s + n - q + 1) for s, n in zip(start, size)]) if codes else np.empty(0, np.int64)
    h = gram_hashes(flat, q)[where] if codes else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    flags = np.zeros(1 << SLOTS, dtype=bool)
    flags[hashes >> np.uint64(64 - SLOTS)] = True
    target = np.searchsorted(start, where[order], side="right") - 1
    first = np.r_[first, len(h)]
    place = np.repeat(np.arange(len(hashes)), np.diff(first)) * len(size) + target
    return Index(flat, start, size, part, edits, part - q + 1 - edits * q, np.array(owners, dtype=np.int64), hashes, first, target, where[order] - start[target], edits[target] + 1, place, flags, short)


def slices(pos: np.ndarray, row: np.ndarray, ix: Index, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int, int]]:
    """First posting and number of each hit, for ranges of diagonals [low, high) and targets [first, last) that hold most postings at most, if one position and target do.

    A range of diagonals has its hits at positions up to the longest target, and its band, behind.
    """
    reach = int(ix.size.max()) + 2 * int(ix.edits.max()) + 4
    place = row * len(ix.size)  # postings are in order of (row, target)
    todo = [(int(pos[0]) - reach, int(pos[-1]) + 1, 0, len(ix.size))] if len(pos) else []
    while todo:
        low, high, first, last = todo.pop()
        a, b = np.searchsorted(pos, (low, high + reach))
        if first == 0 and last == len(ix.size):
            begin, end = ix.first[row[a:b]], ix.first[row[a:b] + 1]
        else:
            begin, end = np.searchsorted(ix.place, place[a:b] + first), np.searchsorted(ix.place, place[a:b] + last)
        n = end - begin
        if n.sum() <= most or (high - low <= reach and last - first == 1):
            yield pos[a:b], begin, n, low, high, last
        elif high - low > reach:
            middle = (low + high) // 2
            todo += [(middle, high, first, last), (low, middle, first, last)]
        else:
            middle = (first + last) // 2
            todo += [(low, high, middle, last), (low, high, first, middle)]


def candidates(code: np.ndarray, ix: Index, q: int = Q, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(target, lowest diagonal) of the bands that reach their bound, slice by slice; a band is 2 (edits + 1) diagonals wide."""
    h = gram_hashes(code, q)
    pos = np.flatnonzero(ix.flags[h >> np.uint64(64 - SLOTS)])
    row = np.searchsorted(ix.hashes, h[pos]).clip(max=len(ix.hashes) - 1)
    real = ix.hashes[row] == h[pos]
    for at, begin, n, low, high, _ in slices(pos[real], row[real], ix, most):
        ends = np.cumsum(n)
        post = np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        band = (np.repeat(at, n) - ix.offset[post] + SHIFT) // ix.step[post]
        key = (ix.target[post] << 32) | band
        key = np.concatenate([key, key - 1])
        with np.errstate(over="ignore"):
            place = ((key.view(np.uint64) * MIX) >> np.uint64(64 - TALLY)).view(np.int64)
        key = key[np.bincount(place, minlength=1 << TALLY)[place] >= ix.bound.min(initial=1)]  # a tally of slots first: it never counts too little
        key, times = np.unique(key, return_counts=True)
        target = key >> 32
        diagonal = (key & 0xFFFFFFFF) * (ix.edits[target] + 1) - SHIFT
        good = (times >= ix.bound[target]) & (diagonal >= low) & (diagonal < high)
        if good.any():
            yield target[good], diagonal[good]


def align(code: np.ndarray, target: np.ndarray, offset: np.ndarray, low: np.ndarray, ix: Index, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each target's part at offset to the best part of code within its band, and where that ends; all at once, row by row.

    A match's path keeps to edits + 1 diagonals, which are whole in one of the overlapping bands. What is over its edits by more than more everywhere is left.
    """
    width = 2 * (int(ix.edits[target].max()) + 1)
    t = np.arange(width, dtype=np.int16)
    low, high = (low + offset).clip(-PAD, None) + PAD, len(code) + PAD
    views = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(PAD, np.uint32), code, np.zeros(PAD + width + WINDOW * 2, np.uint32)], width)
    start, size, most = ix.start[target] + offset, ix.part[target], ix.edits[target] + more
    best, end = np.full(len(target), 1 << 14), np.zeros(len(target), dtype=np.int64)
    live = np.arange(len(target))
    now = np.zeros((len(target), width), dtype=np.int16)
    for i in range(1, int(size.max()) + 1):
        v = now + (views[np.minimum(low[live] + i - 1, high)] != ix.code[start[live] + i - 1][:, None])
        np.minimum(v[:, :-1], now[:, 1:] + 1, out=v[:, :-1])
        now = np.minimum.accumulate(v - t, axis=1) + t
        if (over := size[live] == i).any():
            best[live[over]] = now[over].min(axis=1)
            end[live[over]] = low[live[over]] - PAD + i + now[over].argmin(axis=1)
        if i % 32 == 0 or over.any():
            stay = ~over & (now.min(axis=1) <= most[live])
            live, now = live[stay], now[stay]
            if not len(live):
                break
    return best, end


def aligned(code: np.ndarray, targets: np.ndarray, lows: np.ndarray, ix: Index) -> Iterator[tuple[int, int, int]]:
    """(target, edits, end) of the parts that match: of each candidate those on the grid, or else the best of all offsets.

    Offsets that differ by 1 differ by one edit at most, so where a coarse offset is over its edits by more than SLACK, none within SLACK of it matches.
    """
    most, last = ix.edits[targets], ix.size[targets] - ix.part[targets]

    def grid(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        n = -(-last[rows] // step) + 1
        row = np.repeat(rows, n)
        return row, np.minimum((np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step, last[row])

    def tried(row: np.ndarray, offset: np.ndarray, more: int = 0) -> tuple[np.ndarray, ...]:
        found = [align(code, targets[row[k : k + ROWS]], offset[k : k + ROWS], lows[row[k : k + ROWS]], ix, more) for k in range(0, len(row), ROWS)]
        edits, end = (np.concatenate([f[j] for f in found] or [np.empty(0, np.int64)]) for j in (0, 1))
        good = edits <= most[row] + more
        return row[good], offset[good], edits[good], end[good]

    row, _, edits, end = tried(*grid(np.arange(len(targets)), WINDOW // 2))
    yield from zip(targets[row].tolist(), edits.tolist(), end.tolist())
    left = last > 0
    left[row] = False
    row, near, _, _ = tried(*grid(np.flatnonzero(left), 2 * SLACK), SLACK)
    offset = (near[:, None] + np.arange(-SLACK, SLACK + 1)).ravel().clip(0)
    row = np.repeat(row, 2 * SLACK + 1)
    row, _, edits, end = tried(row, np.minimum(offset, last[row]))
    least = np.full(len(targets), 1 << 14)
    np.minimum.at(least, row, edits)
    best = edits == least[row]
    yield from zip(targets[row[best]].tolist(), edits[best].tolist(), end[best].tolist())


def exact(code: np.ndarray, ix: Index) -> Iterator[tuple[str, int, int]]:
    """(short item, start, end) where it stands in code between bounds of words (space, or the zeros around a text)."""
    text = as_text(code)
    for at, found in ix.finder.iter(text):
        start, end = at - len(found) + 1, at + 1
        if text[start - 1] in "\0 " and text[end] in "\0 ":
            yield found, start, end


def joined(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Passages (start, end, edits) of one item in one text: parts that overlap are one; edits are the most of its parts."""
    found.sort()
    start, end, edits = found[0]
    for s, e, d in found[1:]:
        if s < end:
            end, edits = max(end, e), max(edits, d)
        else:
            yield start, end, edits
            start, end, edits = s, e, d
    yield start, end, edits


def matches(texts: list[str], ix: Index, most: int = SLICE) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the passages of each item in each text; positions in the text, start give or take the edits."""
    if not len(ix.size) and not ix.short:
        return []
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    gap = int(ix.edits.max(initial=0)) + 1  # no match reaches over so many signs that are in no item
    k = 0
    while k < len(texts):
        codes, places, owners, size = [np.zeros(1, np.uint32)], [np.zeros(1, np.int64)], [k], 1
        first = k
        while k < len(texts) and (size <= CHUNK or k == first):
            code, at = normalised(texts[k])
            codes += [code, np.zeros(gap, np.uint32)]
            places += [at, np.full(gap, at[-1] if len(at) else 0)]
            size += len(code) + gap
            owners.append(size)
            k += 1
        code, place, ends = np.concatenate(codes), np.concatenate(places), np.array(owners[1:])
        for name, begin, end in exact(code, ix) if ix.short else ():
            text = int(np.searchsorted(ends, begin, side="right"))
            for item in ix.short[name]:
                found.setdefault((first + text, item), []).append((int(place[begin]), int(place[end - 1]) + 1, 0))
        if len(code) < Q or not len(ix.size):
            continue
        for targets, lows in candidates(code, ix, most=most):
            for target, edits, end in aligned(code, targets, lows, ix):
                last = int(min(max(end - 1, 0), len(code) - 1))
                text = int(np.searchsorted(ends, last, side="right"))
                begin = max(int(last - ix.part[target] + 1), int(ends[text - 1]) if text else 1)
                found.setdefault((first + text, int(ix.item[target])), []).append((int(place[begin]), int(place[last]) + 1, edits))
    return [(t, i, *passage) for (t, i), parts in sorted(found.items()) for passage in joined(parts)]


def pieces(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """i, t: items normalised, in pieces of PIECE characters that overlap by two WINDOWs, so that each part that is looked for is whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            row, made = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                code = normalised(text)[0]
                for at in range(0, max(len(code) - 2 * WINDOW, 1), PIECE - 2 * WINDOW):
                    row.append(k)
                    made.append(as_text(code[at : at + PIECE]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(made, pa.string())], names=["i", "t"])

    return benchmark.select(F.col(f"`{item_col}`").alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"i {type_of(benchmark, item_col)}, t string").distinct()


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, part_chars: int = PART_CHARS) -> Iterator[tuple[list, Index]]:
    """The benchmark's ids and index, in parts of bounded size."""
    cut = store(pieces(benchmark, item_col, text_col), "pieces")
    total = cut.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_chars))
    for k in range(n):
        t = cut.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").toArrow()
        yield t["i"].to_pylist(), index_of(t["t"].to_pylist())
    discard(cut)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """id, item, start long, end long, edits long: for every row of df and benchmark id that matches, its passages (those of a long item's pieces by themselves)."""
    schema = f"`{id_col}` {type_of(df, id_col)}, `{item_col}` {type_of(benchmark, item_col)}, start long, end long, edits long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for ids, ix in parts_of(benchmark, item_col, item_text_col, part_chars):
        shared = df.sparkSession.sparkContext.broadcast((ids, ix))  # part_chars bounds it

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, ix = shared.value
            for b in bounded(batches):
                found = matches(b.column(1).to_pylist(), ix)
                if found:
                    row, item, start, end, edits = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([ids[i] for i in item], item_type), *(pa.array(x, pa.int64()) for x in (start, end, edits))], names=[id_col, item_col, "start", "end", "edits"])

        now = df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)
        out = now if out is None else out.unionByName(now)
    return out


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """df without the rows that hold a benchmark text."""
    stored = None
    for k, (_, ix) in enumerate(parts_of(benchmark, item_col, item_text_col, part_chars)):
        shared = df.sparkSession.sparkContext.broadcast(ix)  # part_chars bounds it

        def run(texts: list[str], shared=shared) -> list[pa.Array]:
            clean = np.ones(len(texts), dtype=bool)
            clean[[m[0] for m in matches(texts, shared.value)]] = False
            return [pa.array(clean)]

        if k:
            last, stored = stored, store(df, "clean")
            df = stored
            if last is not None:
                discard(last)
        df = beside(df, text_col, run, "clean boolean").where("clean").select("row.*")
    return df
