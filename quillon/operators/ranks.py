"""Row numbers in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with name: 1, 2, ... by order, which must be total. Rows are dealt to ranges, ranked within them, and shifted by the counts of the ranges before, one number for each."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).persist()  # the number of a range holds for this copy
    counts = {r._range: r["count"] for r in ranged.groupBy("_range").count().collect()}  # n rows at most
    before, rows = 0, []
    for k in sorted(counts):
        rows.append((k, before))
        before += counts[k]
    shift = F.broadcast(spark.createDataFrame(rows, "_range int, _before long"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(shift, "_range").withColumn(name, F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_before")
