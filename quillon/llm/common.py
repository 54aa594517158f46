"""What the operators of this package share: the shared folder, bounded Arrow batches, text columns, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Most rows of what a Python worker looks at together. The batches themselves are bounded by Spark's own settings (64 MB).
BATCH_ROWS = 256
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, an own one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are deleted at its end; what reads them has to be written before (lasting=True)."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        delete(spark, path)


def store(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, fixes generated ids."""
    spark = df.sparkSession
    path = f"{(None if lasting else _folder.get()) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that store() gave and that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of BATCH_ROWS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            out = f(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, text_col: str, f: Callable[[list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """row (all columns of df as one struct, so that no name clashes) and the columns that f makes of the whole texts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *f(b.column(1).to_pylist())], names=["row", *names])

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    made = StructType.fromDDL(schema)
    names = made.names
    return map_batches(df.select(row.alias("row"), text_or_empty(text_col).alias("text")), run, StructType([StructField("row", df.schema), *made]))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def labelled_texts(df: DataFrame, labels: DataFrame, label: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """text, label of max_rows ids at most: those with the smallest hashes (labels that are null count as none).

    label: an aggregate over the labels of an id. Of several texts of an id the smallest is taken, so the sample is the same for any order or partitioning of df.
    """
    of_id = labels.groupBy(id_col).agg(label.alias("label")).where(F.col("label").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    ids = of_id.select(F.col(f"`{id_col}`").alias("id"), "label").orderBy(F.xxhash64("id"), "id").limit(max_rows)  # bounded, so it may be broadcast
    texts = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "id")
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


def read(spark: SparkSession, sf_dir: str, table: str, dealt: bool = False) -> DataFrame:
    """dealt: anew to so many partitions as quillon.input.partitions says, if it is set (for few files on many cores); else as scanned."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    parts = spark.conf.get("quillon.input.partitions", None) if dealt else None
    return df.repartition(int(parts)) if parts else df
