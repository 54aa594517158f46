"""A task's table of distinct pieces of text, each encoded once.

Many pieces go to the tokenizers library as one text, set apart by a special token: the library splits a text at
special tokens before anything else, so every piece encodes as it does alone, at a fraction of the cost of a call each.
Those texts are batches of about equal bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Most distinct pieces that a table keeps; when full it starts again. Bytes of one text of pieces, and of one batch of texts.
PIECES, TEXT, BATCH = 200_000, 1 << 14, 1 << 18
#: Between a Latin letter and an ASCII sign or digit a pretoken ends, but for "'" (contractions) and "<", "|", ">" (special tokens).
SIGN_AFTER_LETTER = r"(?=[!-&(-;=?@\[-`{}~])(?<=[A-Za-zÀ-ÖØ-öø-ÿ])"


@lru_cache(maxsize=4)
def load(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def specials(file: str) -> tuple[list[str], str, int]:
    """The added tokens' strings; the one that sets pieces apart, and its id."""
    added = load(file).get_added_tokens_decoder()
    found = [(k, a.content) for k, a in added.items() if a.special and not (a.lstrip or a.rstrip or a.single_word or a.normalized)]
    if not found or len(found) < len(added):
        raise ValueError(f"{file} needs plain special tokens only")
    return [a.content for a in added.values()], found[-1][1], found[-1][0]


class PieceTable:
    """Row i has the ids of piece i: flat[ends[i]:ends[i + 1]]."""

    def __init__(self, file: str, most: int = PIECES):
        self.file, self.most = file, most
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The rows of pieces; those not yet known are encoded, each once."""
        if len(self.row) + len(pieces) > self.most:
            self.clear()
        row = self.row
        if new := list(dict.fromkeys(p for p in pieces if p not in row)):
            self.add(new)
        return np.fromiter(map(self.row.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def add(self, new: list[str]) -> None:
        names, sep, sep_id = specials(self.file)
        odd = [p for p in new if "<" in p and any(s in p for s in names)] if all("<" in s for s in names) else [p for p in new if any(s in p for s in names)]
        if odd:
            rare = set(odd)
            new = [p for p in new if p not in rare]
        ids, sizes, texts, held, size, batch = [], [], [], [], 0, 0
        encode = load(self.file).encode_batch

        def flush() -> None:
            for e in encode(texts, add_special_tokens=False):
                got = np.array(e.ids, dtype=np.int32)
                cut = np.flatnonzero(got == sep_id)
                sizes.append(np.diff(np.r_[-1, cut, len(got)]) - 1)
                ids.append(got[got != sep_id])
            texts.clear()

        for p in new:
            held.append(p)
            size += len(p) + len(sep)
            if size >= TEXT:
                texts.append(sep.join(held))
                held, batch, size = [], batch + size, 0
                if batch >= BATCH:
                    flush()
                    batch = 0
        if held:
            texts.append(sep.join(held))
        if texts:
            flush()
        for e in encode(odd, add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.int32))
            sizes.append(np.array([len(e.ids)]))
        at = len(self.row)
        self.row.update(zip([*new, *odd], range(at, at + len(new) + len(odd))))
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), pa.array(self.flat))
