"""Tables of a schema, from Parquet, JDBC or a catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..spec import SchemaSpec


@dataclass(frozen=True)
class Database:
    """A schema and its tables; all reads are lazy and prune to the columns asked for."""

    spec: SchemaSpec
    frames: Mapping[str, DataFrame]

    def __getitem__(self, table: str) -> DataFrame:
        return self.frames[table]

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.frames.values())).sparkSession

    def columns(self, table: str) -> list[str]:
        return self.frames[table].columns

    def sizes(self) -> dict[str, int]:
        """Exact rows of each table (Parquet counts come from footers)."""
        return {t.name: self.frames[t.name].count() for t in self.spec.tables}


def from_parquet(spark: SparkSession, spec: SchemaSpec, folder: str) -> Database:
    return Database(spec, {t.name: spark.read.parquet(f"{folder}/{t.name}.parquet") for t in spec.tables})


def from_catalog(spark: SparkSession, spec: SchemaSpec, database: str | None = None) -> Database:
    return Database(spec, {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in spec.tables})


def from_jdbc(spark: SparkSession, spec: SchemaSpec, url: str, **options: str) -> Database:
    """Needs the database's driver on the classpath."""
    return Database(spec, {t.name: spark.read.format("jdbc").options(url=url, dbtable=t.name, **options).load() for t in spec.tables})


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, list[str]]:
    """Tables of a catalogue with their columns."""
    names = [t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    return {n: spark.table(f"{database}.{n}" if database else n).columns for n in names}
