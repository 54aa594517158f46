"""Inverted index, lengths and statistics of the text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_text, stop_words, tokens
from ..sources.tables import Database

#: Parts that a word's postings are dealt to when an index is written, so that a word of most rows isn't one task's.
SALTS = 8


def identity(db: Database, table: str) -> Column:
    """A row's key as text, parts by '-'. Signs that part keys are written as %7C, %25 and, in keys of several parts, %2D; a null part is %00."""
    columns = db.spec.by_name[table].identity

    def part(c: str) -> Column:
        text = F.replace(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
        return F.coalesce(F.replace(text, F.lit("-"), F.lit("%2D")), F.lit("%00")) if len(columns) > 1 else text

    return F.concat_ws("-", *[part(c) for c in columns])


def tokens_of_rows(db: Database, table: str) -> DataFrame:
    """pk, words: one pass, no shuffle."""
    return db[table].select(identity(db, table).alias("pk"), tokens(row_text(db.spec.by_name[table].text)).alias("words"))


def build_index(db: Database, tables: tuple[str, ...] | None = None, stop: tuple[str, ...] | None = None) -> DataFrame:
    """tbl, word, pk, tf, dl; without stop words, which count in dl. A word's rows of one row are counted where they are, then once more by key, so time is in proportion to the text."""
    skip = list(stop_words() if stop is None else stop)
    out = []
    for t in tables or db.spec.text_tables:
        each = tokens_of_rows(db, t).select("pk", F.size("words").alias("dl"), F.explode("words").alias("word"))
        each = each.where(~F.col("word").isin(skip)) if skip else each
        out.append(each.groupBy("pk", "word").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl")).select(F.lit(t).alias("tbl"), "word", "pk", "tf", "dl"))
    return reduce(DataFrame.unionByName, out)


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Parquet by table and hash of the word, sorted by word, so that a probe reads a few row groups. A bucket's rows are dealt by key to SALTS tasks."""
    salt = F.pmod(F.xxhash64("pk"), F.lit(SALTS))
    index.withColumn("bucket", bucket_of(F.col("word"), buckets)).repartition("tbl", "bucket", salt).sortWithinPartitions("tbl", "bucket", "word", "pk").write.partitionBy("tbl", "bucket").parquet(path)


class WordIndex:
    """A written index of a database: postings by table and bucket, and the tables' sizes and average lengths."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.buckets = buckets
        self.postings = spark.read.parquet(f"{path}/postings")
        self.sizes = {r.tbl: (r.n_rows, r.avgdl or 0.0) for r in spark.read.parquet(f"{path}/sizes").collect()}  # one row a table

    @staticmethod
    def write(db: Database, path: str, buckets: int = 256, stop: tuple[str, ...] | None = None) -> WordIndex:
        write_index(build_index(db, stop=stop), f"{path}/postings", buckets)
        average_lengths(db).coalesce(1).write.parquet(f"{path}/sizes")
        return WordIndex(db.spark, path, buckets)

    def probe(self, table: str, words: list[str]) -> DataFrame:
        return probe(self.postings.where(F.col("tbl") == table), words, self.buckets)


def probe(index: DataFrame, words: list[str], buckets: int | None = None) -> DataFrame:
    found = index.where(F.col("word").isin(words))
    if buckets:
        spark = index.sparkSession
        at = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"), buckets)).distinct().collect()]
        found = found.where(F.col("bucket").isin(at))
    return found


def dictionary(index: DataFrame) -> DataFrame:
    """word, df, occurrences."""
    return index.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def doc_lengths(db: Database, table: str) -> DataFrame:
    """pk, dl: stop words count."""
    return tokens_of_rows(db, table).select("pk", F.size("words").alias("dl"))


def average_lengths(db: Database) -> DataFrame:
    """tbl, n_rows, avgdl."""
    parts = [doc_lengths(db, t).agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl")).select(F.lit(t).alias("tbl"), "n_rows", "avgdl") for t in db.spec.text_tables]
    return reduce(DataFrame.unionByName, parts)
