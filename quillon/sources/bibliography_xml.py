"""Bibliography XML to the tables of spec.BIBLIOGRAPHY.

Records are read by Spark's XML source, one reader for each kind of record; entities get ids by their order of name.
Ids come from ranks within ranges of names and the counts of those, not from one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers

# Record tags, fields, and the kind of a container that is only referred to.
RECORDS = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "www")
FIELDS = ("title", "pages", "year", "volume", "number", "url", "ee", "isbn", "publisher", "series", "crossref", "journal", "booktitle")
CONTAINER = {"article": "journal", "incollection": "book", "inproceedings": "proceedings"}
MANY = ("author", "editor", "cite")
LEAST_CITE = 4

SCHEMA = "_key string, " + ", ".join(f"{f} string" for f in FIELDS) + ", " + ", ".join(f"{f} array<string>" for f in MANY)


def records(spark: SparkSession, path: str, kinds: tuple[str, ...] = RECORDS) -> DataFrame:
    """key, type, the fields, and arrays author, editor, cite."""
    out = None
    for kind in kinds:
        now = spark.read.format("xml").options(rowTag=kind).schema(SCHEMA).load(path).withColumn("type", F.lit(kind)).withColumnRenamed("_key", "key")
        out = now if out is None else out.unionByName(now)
    return out


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with ids 1, 2, ... by the order of a unique column's bytes."""
    return row_numbers(df, [F.col(by).cast("binary").asc()], name)


def names(of: Column) -> Column:
    return F.filter(F.transform(of, lambda x: F.trim(x)), lambda x: x != "")


def load(recs: DataFrame) -> dict[str, DataFrame]:
    """item, person, publisher, series, person_item, cite. Containers and cited works that have no record become stubs."""
    recs = recs.where("key IS NOT NULL")
    # records of one url are one item too: the first key names it
    same = recs.where("url <> ''").groupBy("url").agg(F.min("key").alias("_first"))
    recs = recs.join(same, "url", "left").withColumn("key", F.coalesce("_first", "key")).drop("_first")
    merged = recs.groupBy("key").agg(F.min("type").alias("type"), *[F.max(f).alias(f) for f in FIELDS])  # records of one key are one item
    cites = recs.select("key", F.explode(names("cite")).alias("reference")).where(F.length("reference") >= LEAST_CITE).distinct()
    kind = F.create_map(*[F.lit(x) for pair in CONTAINER.items() for x in pair])
    containers = merged.where("crossref IS NOT NULL").groupBy(F.col("crossref").alias("key")).agg(F.min(F.coalesce(kind[F.col("type")], F.lit("unknown"))).alias("type"))
    cited = cites.select(F.col("reference").alias("key")).distinct().withColumn("type", F.lit("unknown"))
    stubs = containers.unionByName(cited).groupBy("key").agg(F.min_by("type", F.col("type") == "unknown").alias("type"))
    stubs = stubs.join(merged.select("key"), "key", "left_anti")
    items = numbered(merged.unionByName(stubs, allowMissingColumns=True), "key", "item_id")

    def entity(column: str, name: str, id_name: str) -> DataFrame:
        return numbered(merged.select(F.trim(column).alias(name)).where(F.col(name) != "").distinct(), name, id_name)

    publishers, series = entity("publisher", "name", "publisher_id"), entity("series", "title", "series_id")
    wrote = recs.select("key", F.explode(names(F.concat(F.coalesce("author", F.array()), F.coalesce("editor", F.array())))).alias("name")).distinct()
    people = numbered(wrote.select("name").distinct(), "name", "person_id")
    ids = items.select("key", "item_id")
    item = (
        items.join(publishers.select(F.col("name").alias("publisher"), "publisher_id"), "publisher", "left")
        .join(series.select(F.col("title").alias("series"), "series_id"), "series", "left")
        .join(ids.select(F.col("key").alias("crossref"), F.col("item_id").alias("cross_ref")), "crossref", "left")
        .select("item_id", "key", "type", "title", "pages", "year", "volume", "number", "url", "ee", "isbn", "cross_ref", "publisher_id", "series_id")
    )
    person_item = wrote.join(people, "name").join(ids, "key").select("person_id", "item_id")
    cite = cites.join(ids, "key").join(ids.select(F.col("key").alias("reference"), F.col("item_id").alias("_to")), "reference").select("item_id", F.col("_to").alias("reference"))
    return {"item": item, "person": people.select("person_id", "name"), "publisher": publishers, "series": series, "person_item": person_item, "cite": cite}
