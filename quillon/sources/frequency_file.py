"""Dictionaries of word frequencies: lines '<word> <unused> <cumulative count>'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word, occurrences: differences of the running count, by numbers of lines that are dealt to ranges."""
    lines = spark.read.csv(path, sep=" ", schema="word string, unused string, upto long").where("word IS NOT NULL AND upto IS NOT NULL")
    at = row_numbers(lines, [F.col("upto").asc(), F.col("word").asc()], "at")
    before = at.select((F.col("at") + 1).alias("at"), F.col("upto").alias("before"))
    return at.join(before, "at", "left").select("word", (F.col("upto") - F.coalesce("before", F.lit(0))).alias("occurrences"))
