"""BPE encoding and decoding over a table of distinct words.

Spark splits each text at ASCII white space and between letters and signs (JVM side). Within a split of the input an Arrow function holds the
table of distinct words: each is encoded once by the tokenizers library, ids are joined back to every occurrence
by position (Arrow's take), and decoding joins each id to its piece the same way. A word between blanks encodes
alone as it does in the text, as the tokenizer drops white space before it splits, and no rule looks across it.

The table of words is one for each task, not one for the corpus: see README. It is bounded (pieces.PIECES) and starts
again when full; ids don't depend on that. No shuffle, nothing broadcast.

A null text is empty; an empty text has no ids and decodes to the empty text. Long texts are encoded whole, in as many
words at a time as a worker may hold. Equal texts have equal ids; repeated rows stay; null ids stay null. An empty table gives no rows.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded, text_or_empty, type_of
from .pieces import SIGN_AFTER_LETTER, PieceTable, load


@lru_cache(maxsize=4)
def piece_table(file: str) -> pa.Array:
    """Row i is the piece of id i (fixed size: the vocabulary)."""
    t = load(file)
    return pa.array([t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))])


def folded(words: pa.Array) -> pa.Array:
    """A-Z lower-cased, as the tokenizer does itself, so that fewer words are distinct; not where that could make a special token or compose another character."""
    plain = pc.and_(pc.match_substring_regex(words, r"^[!-~\x{C0}-\x{FF}]*$"), pc.invert(pc.match_substring(words, "<")))
    return pc.if_else(plain, pc.ascii_lower(words), words)


def encode_words(words: pa.ListArray, table: PieceTable) -> pa.ListArray:
    """Lists of words to lists of ids: distinct words, their ids, joined back by position."""
    flat = words.flatten()
    coded = flat.dictionary_encode()
    rows = table.rows(folded(coded.dictionary).to_pylist())
    by_word = table.lists().take(pa.array(rows[coded.indices.to_numpy()]))
    start = words.offsets.to_numpy()
    ends = by_word.offsets.to_numpy()[start - start[0]]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), by_word.flatten())


def decode_ids(ids: pa.ListArray, file: str) -> pa.Array:
    """Lists of ids to texts, through the id-to-piece table; pieces are set apart by a blank, as the library does without a decoder."""
    found = piece_table(file).take(ids.flatten())
    start = ids.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array((start - start[0]).astype(np.int32)), found), " ")


def encode_decode(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string, for every row of df."""
    t = json.loads(load(file).to_str())
    kinds = {n["type"] for n in (t["normalizer"] or {}).get("normalizers", [])}
    if t["decoder"] or not {"Lowercase", "NFC"} <= kinds:
        raise ValueError("words encode alone, and decode with blanks between, in lower-casing tokenizers without a decoder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(file)
        for b in bounded(batches):
            at = 0
            size = np.diff(b.column(1).offsets.to_numpy()).cumsum()
            while at < b.num_rows:  # as many rows as hold about 100,000 words
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 100_000)))
                part = b.slice(at, end - at)
                words = pa.ListArray.from_arrays(part.column(1).offsets, part.column(1).values) if part.column(1).null_count == 0 else part.column(1)
                ids = encode_words(words, table)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decode_ids(ids, file)], names=[id_col, "ids", "decoded"])
                at = end

    words = F.split(text_or_empty(text_col), f"{ASCII_SPACE}|{SIGN_AFTER_LETTER}")
    return df.select(F.col(f"`{id_col}`"), words.alias("words")).mapInArrow(run, f"`{id_col}` {type_of(df, id_col)}, ids array<int>, decoded string")
