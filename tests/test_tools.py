"""Reports, the frequency file and the command line."""

from pyspark.sql import functions as F

from quillon.functions.text import cut_tail, replaced, stop_words
from quillon.operators import reports
from quillon.sources.frequency_file import read_frequencies
from quillon.sources.tables import catalog_tables, from_catalog, from_parquet
from quillon.spec import SALES

FOLDER = "/root/testdata/sf0.001"


def test_frequencies(spark, tmp_path):
    (tmp_path / "d.txt").write_text("ant x 3\nbee x 10\ncat x 11\n")
    assert {r.word: r.occurrences for r in read_frequencies(spark, str(tmp_path / "d.txt")).collect()} == {"ant": 3, "bee": 7, "cat": 1}


def test_compare_algorithms(spark):
    rows = reports.compare_algorithms(from_parquet(spark, SALES, FOLDER), "furniture widget", 5).collect()
    assert len(rows) == 5 and len({r.kth_score for r in rows}) == 1 and all(r.run + r.pruned == r.networks for r in rows)


def test_network_timings():
    assert [(x.split()[0], x.split()[2]) for x in reports.network_timings(SALES, 4)] == [("3", "21"), ("4", "49")]


def test_string_tools(spark, tmp_path):
    r = spark.createDataFrame([("a.b.c",)], "t string").select(replaced(F.col("t"), ".", "-").alias("x"), cut_tail(F.col("t"), 2).alias("y"), cut_tail(F.col("t"), 9).alias("z")).first()
    assert tuple(r) == ("a-b-c", "a.b", "")
    (tmp_path / "s.txt").write_text("The\nof\nit's\n\n")
    assert stop_words(str(tmp_path / "s.txt")) == ("of", "the")


def test_jdbc_reads_each_table_by_name(spark, monkeypatch):
    """No driver is here; the reader's options are what counts."""
    from pyspark.sql import DataFrameReader

    from quillon.sources.tables import from_jdbc

    asked = []
    monkeypatch.setattr(DataFrameReader, "load", lambda self: asked.append(self) or spark.range(1))
    db = from_jdbc(spark, SALES, "jdbc:x://there/db", user="me", fetchsize="100")
    assert len(asked) == len(SALES.tables) and set(db.frames) == {t.name for t in SALES.tables}


def test_catalog(spark):
    for t in SALES.tables:
        spark.read.parquet(f"{FOLDER}/{t.name}.parquet").createOrReplaceTempView(t.name)
    assert catalog_tables(spark)["region"][0] == "r_regionkey"
    assert from_catalog(spark, SALES).sizes()["nation"] == 25


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from quillon import __main__ as cli

    (tmp_path / "run.txt").write_text("K = 3\nALGS = 1 10\n\nq1 furniture widget\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    cli.main(str(tmp_path / "run.txt"), FOLDER)
    out = capsys.readouterr().out.splitlines()
    assert sum(x.startswith("Qq1 Asparse T") for x in out) == 3 and any("pruned=" in x for x in out)
