"""Token counts: Arrow batches in, lengths out.

count_tokens encodes whole texts with a public tokenizer inside an Arrow function and returns lengths only.
Texts are split at safe boundaries (JVM side), so a long text is many short pieces; a task encodes each distinct
piece once, in batches of about equal bytes (pieces.py), and adds up the lengths of a text's pieces. A worker holds one
bounded Arrow batch and one bounded table, whatever the length of a text. No shuffle: the scan's splits are balanced by bytes.

Nulls and empty texts count 0 bytes and 0 tokens. Repeated rows give repeated rows; a null id stays null.
Other columns, whatever their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_or_empty, type_of
from .pieces import SIGN_AFTER_LETTER, PieceTable, load

#: Before a blank or line end that follows a visible ASCII or Latin character no pretoken goes on, no character composes, and no special token stands.
SAFE = rf"(?=[ \n])(?<=[!-~À-ɏ])|{SIGN_AFTER_LETTER}"
#: Words that are counted at a time.
PART = 100_000


@lru_cache(maxsize=4)
def may_split(file: str) -> bool:
    """Whether texts may be split at SAFE: byte-level BPE of .json files that adds no blank of its own."""
    if not file.endswith(".json"):
        return False  # sentencepiece's normalizer strips and joins blanks
    t = json.loads(load(file).to_str())
    return t["normalizer"] is None and (t["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not t["pre_tokenizer"]["add_prefix_space"]


def whole_lengths(texts: list[str], file: str) -> list[int]:
    if file.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=file).encode(texts, num_threads=1)]
    return [len(load(file).encode(t, add_special_tokens=False)) for t in texts]


def count_tokens(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes long (UTF-8), n_tokens long, for every row of df."""
    names = [id_col, "n_bytes", "n_tokens"]

    def by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(file)
        for b in bounded(batches):
            counts = np.diff(b.column(2).offsets.to_numpy())
            total = np.zeros(b.num_rows, dtype=np.int64)
            of = np.repeat(np.arange(b.num_rows), counts)
            flat = b.column(2).flatten()
            for k in range(0, len(flat), PART):
                coded = flat.slice(k, PART).dictionary_encode()
                rows = table.rows(coded.dictionary.to_pylist())
                np.add.at(total, of[k : k + PART], np.diff(table.ends)[rows][coded.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total)], names=names)

    def by_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole_lengths(b.column(2).to_pylist(), file), type=pa.int64())], names=names)

    text, split = text_or_empty(text_col), may_split(file)
    source = df.select(F.col(f"`{id_col}`"), F.octet_length(text).cast("long").alias("n_bytes"), (F.split(text, SAFE) if split else text).alias("text"))
    return source.mapInArrow(by_pieces if split else by_texts, f"`{id_col}` {type_of(df, id_col)}, n_bytes long, n_tokens long")
