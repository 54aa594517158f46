"""Results as text and HTML."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import escaped, highlight, two_places
from ..operators.query import KeywordQuery


def highlighted(found: DataFrame, query: KeywordQuery) -> DataFrame:
    """score_text, cn_key, node_keys, and text: the nodes' texts escaped for HTML with keywords in <b>, and drill: a query by the first text as a phrase of its table."""
    words = [w for k in query.ranked for w in k.words]
    nodes = F.filter("nodes", lambda n: n["text"].isNotNull())
    text = F.array_join(F.transform(nodes, lambda n: F.concat(n["tbl"], F.lit(": "), n["text"])), " | ")
    first = F.try_element_at(nodes, F.lit(1))
    drill = F.concat(first["tbl"], F.lit(":'"), F.lower(first["text"]), F.lit("'"))
    return found.select(two_places(F.col("score")).alias("score_text"), "cn_key", "node_keys", highlight(escaped(text), words).alias("text"), drill.alias("drill"))


def lines(query_id: str, algorithm: str, rows: Iterable[Row]) -> Iterable[str]:
    """Console lines, as results come."""
    for n, r in enumerate(rows, 1):
        yield f"Q{query_id} A{algorithm} T{n} {r.score:.2f} {r.node_keys}"


def html_table(rows: Iterable[Row]) -> str:
    """rows of highlighted()."""
    body = "".join(f"<tr><td>{r.score_text}</td><td>{html.escape(r.cn_key)}</td><td>{r.text}</td><td>{html.escape(r.drill or '')}</td></tr>" for r in rows)
    return f"<table><tr><th>score</th><th>network</th><th>rows</th><th>more</th></tr>{body}</table>"


def stats_row(df: DataFrame, query: str, algorithm: str, metrics: dict[str, float]) -> DataFrame:
    names = sorted(metrics)
    return df.sparkSession.createDataFrame([(query, algorithm, *[float(metrics[n]) for n in names])], "query string, algorithm string, " + ", ".join(f"{n} double" for n in names))
