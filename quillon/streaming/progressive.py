"""Progressive results: rows are given as soon as they are certain, and a search can go on where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row

from ..operators.topk import prepare, results
from ..sources.tables import Database


class Progressive:
    """next(n) gives the n rows after those given so far, best first, up to most rows in all."""

    def __init__(self, db: Database, text: str, most: int = 100, algorithm: str = "sparse", **how):
        self.rows: Iterator[Row] = results(prepare(db, text, **how), most, algorithm)

    def next(self, n: int = 1) -> list[Row]:
        return [r for _, r in zip(range(n), self.rows)]
