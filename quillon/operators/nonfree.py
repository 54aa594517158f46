"""Rows that hold keywords, with their counts and local score, and the statistics that scoring needs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.score import Params, damp_column, idf, idf_plus_one
from ..functions.text import has_phrase, row_text, term_count, tokens
from ..sources.tables import Database
from ..sources.workspace import Workspace
from .index import WordIndex, identity
from .query import Keyword, KeywordQuery
from .ranks import row_numbers

#: Bytes of a table, as Spark's plans estimate them, from which few parts are dealt anew.
DEALT_BYTES = 1_000_000


def count_of(k: Keyword, table: str, text: tuple[str, ...], words: Column) -> Column:
    """tf of a keyword in a row: 0 in tables that it isn't for; a phrase counts once at most."""
    if k.table is not None and k.table != table:
        return F.lit(0)
    return has_phrase(text, list(k.words)).cast("int") if k.phrase else term_count(words, k.words[0])


@dataclass(frozen=True)
class Stats:
    """Of a query's keywords over the text tables."""

    query: KeywordQuery
    n: int
    sizes: dict[str, int]
    avgdl: dict[str, float]
    df: dict[tuple[str, Keyword], int]
    max_tf: dict[tuple[str, Keyword], int]
    n_nonfree: dict[str, int]

    @property
    def keywords(self) -> tuple[Keyword, ...]:
        return self.query.ranked

    @property
    def total_df(self) -> dict[Keyword, int]:
        return {k: sum(self.df[t, k] for t in self.sizes) for k in self.keywords}

    @property
    def idfs(self) -> list[float]:
        """A keyword for one table has that table's df, over all rows."""
        df = self.total_df
        return [idf(self.n, df[k], i) for i, k in enumerate(self.keywords)]

    @property
    def idfs_plus_one(self) -> list[float]:
        df = self.total_df
        return [idf_plus_one(self.n, df[k]) for k in self.keywords]

    @property
    def tables(self) -> list[str]:
        """Those with keyword rows."""
        return [t for t in self.sizes if any(self.df[t, k] for k in self.keywords)]


def statistics(db: Database, query: KeywordQuery, strict: bool = False) -> Stats | None:
    """One aggregate over each text table, all in one job; O(keywords x tables) numbers reach the driver. None if no keyword survives."""
    parts = []
    ks = query.ranked
    for t in db.spec.text_tables:
        text = db.spec.by_name[t].text
        words = db[t].select(*text, tokens(row_text(text)).alias("_w"))
        counts = words.select(F.size("_w").alias("dl"), *[count_of(k, t, text, F.col("_w")).alias(f"c{i}") for i, k in enumerate(ks)])
        any_ = reduce(Column.__or__, [F.col(f"c{i}") > 0 for i in range(len(ks))])
        parts.append(
            counts.agg(
                F.lit(t).alias("t"), F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.count_if(any_).alias("nf"),
                F.array(*[F.count_if(F.col(f"c{i}") > 0) for i in range(len(ks))]).alias("df"), F.array(*[F.coalesce(F.max(f"c{i}"), F.lit(0)) for i in range(len(ks))]).alias("top"),
            )
        )
    rows = {r.t: r for r in reduce(DataFrame.unionByName, parts).collect()}
    df = {(t, k): r.df[i] for t, r in rows.items() for i, k in enumerate(ks)}
    left = query.surviving({k: sum(df[t, k] for t in rows) for k in ks}, strict)
    if left is None:
        return None
    return Stats(left, sum(r.n for r in rows.values()), {t: r.n for t, r in rows.items()}, {t: r.avgdl for t, r in rows.items()}, df, {(t, k): r.top[i] for t, r in rows.items() for i, k in enumerate(ks)}, {t: r.nf for t, r in rows.items()})


def local_score(tfs: list[Column], idfs: list[float]) -> Column:
    score = F.lit(0.0)
    for tf, i in zip(tfs, idfs):
        score = score + damp_column(tf) * F.lit(i)
    return score


def node_columns(db: Database, table: str) -> list[Column]:
    """Join columns of a node, and its key as text."""
    return [*[F.col(c) for c in db.spec.columns(table)], identity(db, table).alias("key")]


def without_excluded(db: Database, table: str, query: KeywordQuery, df: DataFrame) -> DataFrame:
    """Rows whose text has no excluded keyword."""
    text = db.spec.by_name[table].text
    for k in query.excluded if text else ():
        df = df.where(count_of(k, table, text, tokens(row_text(text))) == 0)
    return df


def nonfree(db: Database, table: str, stats: Stats, p: Params = Params()) -> DataFrame:
    """Join columns, key, dl, tf array<int>, score of the rows of table that hold a keyword and none excluded."""
    text = db.spec.by_name[table].text
    words = F.col("_w")
    rows = without_excluded(db, table, stats.query, db[table]).withColumn("_w", tokens(row_text(text)))
    counts = rows.select(*node_columns(db, table), *text, F.size(words).alias("dl"), F.array(*[count_of(k, table, text, words) for k in stats.keywords]).alias("tf")).drop(*text)
    found = counts.where(F.exists("tf", lambda c: c > 0))
    return found.withColumn("score", local_score([F.col("tf")[i] for i in range(len(stats.keywords))], stats.idfs))


def free(db: Database, table: str, query: KeywordQuery) -> DataFrame:
    return without_excluded(db, table, query, db[table]).select(*node_columns(db, table))


def ranked(nf: DataFrame) -> DataFrame:
    """nf with row_n by score, and block: the last row_n of its score. Rows are numbered in ranges; scores are counted once each."""
    score = F.round("score", 9)
    numbered = row_numbers(nf.withColumn("_s", score), [F.col("_s").desc(), F.col("key").asc()], "row_n")
    return numbered.join(numbered.groupBy("_s").agg(F.max("row_n").alias("block")), "_s").drop("_s")


def applies(query: KeywordQuery, table: str) -> bool:
    return any(k.table in (None, table) for k in query.ranked)


def dealt(db: Database, table: str) -> DataFrame:
    """A text table's join, key and text columns; dealt anew to all cores if it is over DEALT_BYTES in fewer parts than these, as parting its words takes far longer than reading it."""
    rows, spark = db[table], db.spark
    rows = rows.select(*dict.fromkeys((*db.spec.columns(table), *db.spec.by_name[table].text)))
    cores = spark.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= DEALT_BYTES or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, *db.spec.by_name[table].identity)


def scanned(db: Database, table: str, query: KeywordQuery) -> DataFrame:
    """Join columns, key, dl, tf, bad (an excluded keyword is there) of all rows of a text table."""
    text = db.spec.by_name[table].text
    words = F.col("_w")
    bad = reduce(Column.__or__, [count_of(k, table, text, words) > 0 for k in query.excluded], F.lit(False))
    rows = dealt(db, table).withColumn("_w", tokens(row_text(text)))
    return rows.select(*node_columns(db, table), F.size(words).alias("dl"), F.array(*[count_of(k, table, text, words) for k in query.ranked]).alias("tf"), bad.alias("bad"))


def probed(db: Database, index: WordIndex, table: str, query: KeywordQuery) -> DataFrame:
    """The same of the rows that hold a word of the query, by the index: postings pivoted by key, joined to the base table; phrases are looked up in the text again."""
    text = db.spec.by_name[table].text
    words = sorted({w for k in query.keywords if k.table in (None, table) for w in k.words})
    tf = {w: F.max(F.when(F.col("word") == w, F.col("tf")).otherwise(0)) for w in words}
    pivot = index.probe(table, words).groupBy("pk").agg(F.max("dl").alias("dl"), *[c.alias(f"w{i}") for i, c in enumerate(tf.values())])

    def count(k: Keyword) -> Column:
        if k.table not in (None, table):
            return F.lit(0)
        at = [F.col(f"w{words.index(w)}") for w in k.words]
        if not k.phrase:
            return at[0]
        return (reduce(Column.__and__, [c > 0 for c in at]) & has_phrase(text, list(k.words))).cast("int")

    base = db[table].select(*node_columns(db, table), *([F.struct(*text).alias("_text")] if any(k.phrase for k in query.keywords) else []))
    joined = pivot.join(base, F.col("pk") == F.col("key"))
    if any(k.phrase for k in query.keywords):
        joined = joined.select("*", *[F.col(f"_text.{c}").alias(c) for c in text if c not in db.spec.columns(table)])
    bad = reduce(Column.__or__, [count(k) > 0 for k in query.excluded], F.lit(False))
    return joined.select(*[F.col(c) for c in (*db.spec.columns(table), "key", "dl")], F.array(*[count(k).cast("int") for k in query.ranked]).alias("tf"), bad.alias("bad"))


class KeywordRows:
    """The keyword rows of a query, written once and shared by all its networks; text tables are scanned once (or probed by an index), and not again.

    The folder is deleted by drop().
    """

    def __init__(self, db: Database, query: KeywordQuery, strict: bool = False, index: WordIndex | None = None):
        self.db = db
        self.space = Workspace(db.spark, "keywords")
        self.stats: Stats | None = None
        n = len(query.ranked)
        tables = [t for t in db.spec.text_tables if applies(query, t)]
        seen = {t: Observation() for t in tables}
        parts = []
        for t in tables:
            if index:
                rows = probed(db, index, t, query)
            else:
                rows = scanned(db, t, query).observe(seen[t], F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
            rows = rows.where(F.exists("tf", lambda c: c > 0))
            parts.append(rows.select(F.lit(t).alias("tbl"), "key", "dl", "tf", "bad", *[F.col(c).alias(f"{t}__{c}") for c in db.spec.columns(t)]))
        if not parts:
            return
        self.rows = self.space.table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "rows", "tbl")
        tf = [F.col("tf")[i] for i in range(n)]
        found = {r.tbl: r for r in self.rows.groupBy("tbl").agg(F.count("*").alias("nf"), F.array(*[F.count_if(c > 0) for c in tf]).alias("df"), F.array(*[F.max(c) for c in tf]).alias("top"), F.max(F.length("key")).alias("longest")).collect()}
        self.longest = {t: r.longest for t, r in found.items()}
        others = [t for t in db.spec.text_tables if t not in tables and not index]
        size = dict(index.sizes) if index else {t: (o.get["n"], o.get["avgdl"] or 0.0) for t, o in seen.items()}
        for t in others:
            r = scanned(db, t, query).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
            size[t] = (r.n, r.avgdl or 0.0)
        ks, order = query.ranked, db.spec.text_tables
        df = {(t, k): found[t].df[i] if t in found else 0 for t in order for i, k in enumerate(ks)}
        top = {(t, k): found[t].top[i] if t in found else 0 for t in order for i, k in enumerate(ks)}
        left = query.surviving({k: sum(df[t, k] for t in order) for k in ks}, strict)
        if left is None:
            return
        self.kept = [ks.index(k) for k in left.ranked]  # places of the keywords that are left in tf
        self.stats = Stats(left, sum(size[t][0] for t in order), {t: size[t][0] for t in order}, {t: size[t][1] for t in order}, df, top, {t: found[t].nf if t in found else 0 for t in order})

    def __getitem__(self, table: str) -> DataFrame:
        """Like nonfree(): join columns, key, dl, tf, score of the rows without excluded keywords."""
        tf = F.array(*[F.col("tf")[i] for i in self.kept])
        own = self.rows.where((F.col("tbl") == table) & ~F.col("bad")).select(*[F.col(f"{table}__{c}").alias(c) for c in self.db.spec.columns(table)], "key", "dl", tf.alias("tf"))
        own = own.where(F.exists("tf", lambda c: c > 0))
        return own.withColumn("score", local_score([F.col("tf")[i] for i in range(len(self.kept))], self.stats.idfs))

    def drop(self) -> None:
        self.space.drop()
