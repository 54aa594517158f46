"""Searches over a small film schema, against brute force, and over the sales tables, against DuckDB."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.score import Params, damp, size_weight
from quillon.functions.text import clean, clean_compact, tokens, tokens_of
from quillon.operators import index, topk
from quillon.operators.query import AND, NOT, parse
from quillon.sinks.render import highlighted, html_table, lines, stats_row
from quillon.sources.bibliography_xml import load, records
from quillon.sources.tables import Database
from quillon.spec import FILMS
from quillon.streaming.progressive import Progressive

WORDS = ["red", "blue", "green", "war", "love", "noir"]


@pytest.fixture(scope="module")
def films(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    film = [(i, text(3).title() or None, text(5)) for i in range(14)]
    genre = [(i, text(2), text(2)) for i in range(5)]
    link = [(i, r.randrange(14), r.randrange(5)) for i in range(30)]
    db = Database(
        FILMS,
        {
            "film": spark.createDataFrame(film, "id long, name string, description string").cache(),
            "genre": spark.createDataFrame(genre, "id long, name string, description string").cache(),
            "film_genre": spark.createDataFrame(link, "id long, film long, genre long").cache(),
        },
    )
    return db, film, genre, link


def brute(data, text, k, p=Params()):
    """All trees of size 3 at most, by loops."""
    _, film, genre, link = data
    q = parse(text)
    docs = {("film", i): tokens_of(f"{a or ''} {b}") for i, a, b in film} | {("genre", i): tokens_of(f"{a} {b}") for i, a, b in genre}
    ks = [w for w in q.ranked if any(w.words[0] in d and w.table in (None, t) for (t, _), d in docs.items())]
    if not ks:
        return []
    tf = lambda n, w: docs[n].count(w.words[0]) if w.table in (None, n[0]) else 0
    n = len(docs)
    import math

    df = [sum(tf(d, w) > 0 for d in docs) for w in ks]
    idfs = [math.log(max(n - f, 0.5) / f) + 1e-13 * i for i, f in enumerate(df)]
    avg = {t: sum(len(d) for (x, _), d in docs.items() if x == t) / sum(x == t for x, _ in docs) for t in ("film", "genre")}
    out = []
    trees = [((d,), f"{d[0]}*", [d]) for d in docs] + [((("film_genre", i), ("film", f), ("genre", g)), None, [("film", f), ("genre", g)]) for i, f, g in link]
    for nodes, name, held in trees:
        if any(sum(tf(h, w) for w in ks) == 0 for h in held):
            continue
        if any(w.words[0] in docs[h] for w in q.excluded for h in held):
            continue
        tfs = [sum(tf(h, w) for h in held) for w in ks]
        if any(w.group == AND and t == 0 for w, t in zip(ks, tfs)):
            continue
        dl, avdl, m = sum(len(docs[h]) for h in held), sum(avg[h[0]] for h in held), sum(t == 0 for t in tfs)
        score = sum(damp(t) * i for t, i in zip(tfs, idfs)) * size_weight(len(nodes), len(held), len(ks), p)
        score *= (len(ks) ** (1 / p.alpha) - m ** (1 / p.alpha)) * ((1 - p.s) / (1 - p.s + p.s * dl / avdl))
        out.append((round(score, 6), len(nodes)))
    return sorted(out, key=lambda r: (-r[0], r[1]))[:k]


@pytest.mark.parametrize("text", ["red blue", "+red +blue", "red -war", "film:red genre:blue", "love zzzz", "red blue green", "zzzz"])
def test_search_against_brute_force(films, text):
    db = films[0]
    found = topk.search(db, text, 12, max_size=3)
    assert [(round(r.score, 6), r.cn_size) for r in found.collect()] == brute(films, text, 12)


@pytest.mark.parametrize("algorithm", ["sparse", "global_pipeline", "queue_pipeline", "two_level_bound", "tree_pipeline"])
def test_algorithms_agree(films, algorithm):
    whole = topk.search_plan(films[0], "red war", 8, max_size=4).collect()
    assert topk.search(films[0], "red war", 8, algorithm, max_size=4).collect() == whole
    with pytest.raises(ValueError):
        topk.search(films[0], "red", 1, "unknown")


def test_pruning_keeps_results_for_random_queries(films):
    r = random.Random(1)
    for _ in range(2):
        text = " ".join(r.sample(WORDS, 2))
        s = topk.prepare(films[0], text, max_size=4)
        rows = list(topk.results(topk.prepare(films[0], text, max_size=4), 3))
        assert rows == topk.search_plan(films[0], text, 3, max_size=4).collect()
        for n in s.networks:
            best = s.planner.scored(n).agg(F.max("score")).first()[0]
            assert best is None or best <= s.planner.bound(n) + 1e-9


def test_prefix_and_progressive(films):
    five = topk.search(films[0], "red blue", 5).collect()
    assert topk.search(films[0], "red blue", 6).collect()[:5] == five
    p = Progressive(films[0], "red blue", 5)
    assert [*p.next(2), *p.next(9)] == five and p.next() == []


def test_not_never_adds_and_phrase_needs_neighbours(films):
    some = {r.node_keys for r in topk.search(films[0], "red -blue", 1000).collect()}
    assert some <= {r.node_keys for r in topk.search(films[0], "red", 1000).collect()}
    for r in topk.search_with_texts(films[0], "'red blue'", 50, max_size=1).collect():
        assert "red blue" in r.nodes[0].text.lower()


def test_invalid_and_strict(films):
    assert topk.search(films[0], "'red").count() == 0
    assert topk.search(films[0], "red +zzzz").count() > 0 and topk.search(films[0], "red +zzzz", strict=True).count() == 0


def test_render(spark, films):
    q = parse("red")
    found = highlighted(topk.search_with_texts(films[0], "red", 3), q).collect()
    assert all("<b>red</b>" in r.text for r in found) and html_table(found).count("<tr>") == 4
    rows = topk.search(films[0], "red", 2).collect()
    assert [x.split()[:3] for x in lines("7", "sparse", rows)] == [["Q7", "Asparse", "T1"], ["Q7", "Asparse", "T2"]]
    assert stats_row(films[0]["film"], "red", "sparse", {"run": 1}).first().run == 1.0


def test_text_functions(spark):
    df = spark.createDataFrame([("Red, red-PLATE x é",), (None,), ("",)], "t string")
    got = df.select(tokens(F.col("t")).alias("w"), clean(F.col("t")).alias("c"), clean_compact(F.col("t")).alias("k")).collect()
    assert [r.w for r in got] == [["red", "red", "plate", "é"], [], []] and got[0].c == " red  red  plate  é " and got[0].k == "red red plate x é"


def test_index_round_trip(spark, films, tmp_path):
    made = index.build_index(films[0], stop=())
    index.write_index(made, str(tmp_path / "ix"), 8)
    back = spark.read.parquet(str(tmp_path / "ix"))
    assert {tuple(r) for r in index.probe(back, ["red"], 8).select("tbl", "pk", "tf").collect()} == {tuple(r) for r in made.where("word = 'red'").select("tbl", "pk", "tf").collect()}


XML = """<dblp>
<article key="a1"><author>Ann</author><author>Bob</author><title>One</title><year>2001</year><cite>b1</cite><cite>...</cite><cite>conf/x1</cite></article>
<inproceedings key="b1x"><author>Bob</author><title>Two</title><crossref>conf/p9</crossref></inproceedings>
<proceedings key="conf/p1"><editor>Cyd</editor><title>Three</title><publisher>Pub</publisher><series>Ser</series></proceedings>
</dblp>"""


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    t = load(records(spark, str(tmp_path / "d.xml")))
    items = {r.key: r for r in t["item"].collect()}
    assert set(items) == {"a1", "b1x", "conf/p1", "conf/p9", "conf/x1"}
    assert items["conf/p9"].type == "proceedings" and items["b1x"].cross_ref == items["conf/p9"].item_id
    assert sorted(r.item_id for r in t["item"].collect()) == [1, 2, 3, 4, 5]
    assert {(r.person_id, r.name) for r in t["person"].collect()} == {(1, "Ann"), (2, "Bob"), (3, "Cyd")}
    assert [(r.item_id, r.reference) for r in t["cite"].collect()] == [(items["a1"].item_id, items["conf/x1"].item_id)]
    assert t["person_item"].count() == 4 and items["conf/p1"].publisher_id == 1


@pytest.mark.parametrize("algorithm", topk.ALGORITHMS)
def test_algorithms_agree_over_small_blocks(films, algorithm, monkeypatch):
    """Blocks of two rows, so that many are taken: the same rows as the exhaustive plan."""
    monkeypatch.setattr(topk, "BLOCK", 2)
    whole = topk.search_plan(films[0], "red war", 3, max_size=3).collect()
    assert list(topk.results(topk.prepare(films[0], "red war", max_size=3), 3, algorithm)) == whole


def test_blocks_read_fewer_keyword_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    film = [(i, "red red red war" if i < 4 else "red", "x" * (i % 7)) for i in range(200)] + [(500 + i, "dull", "y") for i in range(300)]
    none = [("genre", "id long, name string, description string"), ("film_genre", "id long, film long, genre long")]
    db = Database(FILMS, {"film": spark.createDataFrame(film, "id long, name string, description string"), **{t: spark.createDataFrame([], s) for t, s in none}})
    read = {}
    for algorithm in ("sparse", "queue_pipeline", "global_pipeline"):
        s = topk.prepare(db, "red war", max_size=1)
        assert [r.score for r in topk.results(s, 2, algorithm)] == [r.score for r in topk.search(db, "red war", 2, max_size=1).collect()]
        read[algorithm] = s.metrics["rows_in"]
    assert read["sparse"] == 200 and read["queue_pipeline"] <= 20 and read["global_pipeline"] <= 20


def test_tight_bounds_hold_and_are_no_larger(films):
    s = topk.prepare(films[0], "red blue", max_size=4)
    units = topk.TwoLevel(s, 3)
    for n in s.networks:
        best = s.planner.scored(n).agg(F.max("score")).first()[0]
        tight = units.tight(n)  # no bound where an idf is negative
        assert (tight <= s.planner.bound(n) or min(s.planner.stats.idfs) < 0) and (best is None or best <= tight + 1e-9)
    s.close()


def test_halves_are_shared_and_empty_ones_are_pruned(spark):
    r = random.Random(8)
    film = [(i, "red" if i < 3 else "dull", "x") for i in range(9)]
    genre = [(i, "war" if i < 2 else "dull", "y") for i in range(4)]
    link = [(i, r.randrange(9), r.randrange(4)) for i in range(40)]
    tables = {"film": (film, "id long, name string, description string"), "genre": (genre, "id long, name string, description string"), "film_genre": (link, "id long, film long, genre long")}
    db = Database(FILMS, {t: spark.createDataFrame(rows, schema) for t, (rows, schema) in tables.items()})
    assert topk.search(db, "red war", 40, "tree_pipeline", max_size=5).collect() == topk.search_plan(db, "red war", 40, max_size=5).collect()
    lonely = Database(FILMS, {**db.frames, "film_genre": db["film_genre"].limit(0)})
    s = topk.prepare(lonely, "red war", max_size=5)
    assert len(list(topk.results(s, 40, "tree_pipeline"))) == 5 and s.metrics["run"] < len(s.networks)


def test_search_over_the_index(spark, films, tmp_path):
    words = index.WordIndex.write(films[0], str(tmp_path / "ix"), 8, stop=())
    for text in ("red blue", "red -war", "film:red genre:blue", "'red blue' love", "+red +war", "love zzzz"):
        assert topk.search(films[0], text, 12, max_size=3, words=words).collect() == topk.search(films[0], text, 12, max_size=3).collect()


def test_keyword_rows_are_dropped_and_a_search_can_time_out(films):
    import os

    s = topk.prepare(films[0], "red", max_size=3)
    path = s.planner.keyword_rows.space.path.removeprefix("file://")
    assert os.path.isdir(path)
    rows = list(topk.results(s, 3, timeout=0.0))
    assert not os.path.isdir(path) and s.metrics["timed_out"] == 1.0 and len(rows) <= 3


def test_keys_hold_signs_that_part_them(spark):
    from quillon.spec import SchemaSpec, Table

    spec = SchemaSpec("k", (Table("t", ("a", "b"), ("x",)),))
    rows = [("a-b", "c", "red one"), ("a", "b-c", "red two"), ("a|%", None, "red three")]
    db = Database(spec, {"t": spark.createDataFrame(rows, "a string, b string, x string")})
    found = topk.search_with_texts(db, "red", 9).collect()
    assert len({r.node_keys for r in found}) == 3 and {r.nodes[0].text for r in found} == {"red one", "red two", "red three"}


def test_row_numbers(spark):
    from quillon.operators.ranks import row_numbers

    r = random.Random(3)
    rows = [(r.randrange(4), i) for i in range(500)]
    got = row_numbers(spark.createDataFrame(rows, "s int, k int").repartition(5), [F.col("s").desc(), F.col("k").asc()], "n", 7).collect()
    assert [(x.s, x.k) for x in sorted(got, key=lambda x: x.n)] == sorted(rows, key=lambda x: (-x[0], x[1])) and sorted(x.n for x in got) == list(range(1, 501))


def test_html_is_escaped_and_marks_are_not_marked_again(spark):
    from quillon.functions.text import escaped, highlight

    df = spark.createDataFrame([("<i>Bold</i> & b",)], "t string")
    assert df.select(highlight(escaped(F.col("t")), ["bold", "b"]).alias("t")).first().t == "&lt;i&gt;<b>bold</b>&lt;/i&gt; &amp; <b>b</b>"


DIFFER = [("topk_table", "topk_number"), ("topk_star", "topk_or"), ("topk_both_orders", "topk_pinned_cn"), ("topk_punctuated", "topk_or"), ("topk_and", "topk_spaced_plus")]


def test_queries_differ_from_their_controls(spark):
    from quillon.queries import QUERIES

    found = {n: [tuple(r) for r in QUERIES[n](spark, "/root/testdata/sf0.01").collect()] for n in dict.fromkeys(x for pair in DIFFER for x in pair)}
    assert all(found[a] and found[a] != found[b] for a, b in DIFFER)


@pytest.mark.parametrize("name", ["topk_or", "topk_size5", "cn_size4_star", "nonfree_phrase", "dictionary_part"])
def test_queries_against_duckdb(spark, name):
    import glob
    import os

    import duckdb

    from quillon.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    text = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))
    assert text(got) == text(want)


def test_entry_lists_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert not [a for a, b in itertools.combinations(list(e.queries()), 2) if a == b] and NOT
