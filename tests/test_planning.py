"""Parser, networks and formulas: plain Python."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.functions.score import Params, completeness, damp, idf, size_weight
from quillon.functions.text import tokens_of
from quillon.operators.query import AND, NOT, OR, parse
from quillon.plans.networks import Edge, Network, NetworkIndex, generate
from quillon.sources.run_file import read_config, read_queries
from quillon.spec import BIBLIOGRAPHY, BUILT_IN, FILMS, IMDB, MONDIAL, SALES, SchemaSpec


@pytest.mark.parametrize(
    ("text", "groups"),
    [
        ("furniture widget", [OR, OR]), ("+furniture +widget", [AND, AND]), ("+ furniture widget", [OR, OR]), ("furniture -red", [OR, NOT]), ("-red furniture", [OR, NOT]),
        ("'red plate'", [OR]), ('furniture "red plate"', [OR, OR]), ("customer:furniture part:widget", [OR, OR]), ("part:+red", [AND]), ("x-ray-beam", [OR]),
    ],
)
def test_parse(text, groups):
    assert [k.group for k in parse(text).keywords] == groups


@pytest.mark.parametrize("text", ["a", "'red", "", "   ", "-red", "@3"])
def test_invalid(text):
    assert parse(text) is None


def test_parse_parts():
    q = parse("@3 customer:furniture 'red plate' part:*")
    assert q.network == 3 and q.stars == {"part"} and q.keywords[0].table == "customer" and q.keywords[1].phrase
    assert parse(str(q)) == q


@given(st.text(alphabet="ab cd'\"+-:@*12.\n", max_size=40))
def test_parse_never_fails_and_round_trips(text):
    q = parse(text)
    if q is not None:
        assert parse(str(q)) == q


@pytest.mark.parametrize(
    ("spec", "tables", "counts"),
    [
        (FILMS, ["film", "genre"], [2, 2, 3, 3, 7]), (FILMS, ["film"], [1, 1, 1, 1, 2]), (SALES, ["customer", "part"], [2, 2, 3, 5, 10]),
        (SALES, ["part", "supplier"], [2, 2, 4, 5, 16]), (SALES, ["region", "part"], [2, 2, 2, 2, 5]), (SALES, ["customer"], [1, 1, 2, 3, 5]), (SALES, list(SALES.text_tables), [5, 8, 21, 49, 135]),
    ],
)
def test_network_counts(spec, tables, counts):
    assert [len(generate(spec, tables, m)) for m in range(1, 6)] == counts


def test_networks_hold_the_rules():
    for net in generate(BIBLIOGRAPHY, BIBLIOGRAPHY.text_tables, 4):
        assert all(net.nodes[k][1] for k in net.leaves())
        assert len({(e.fk, e.key) for e in net.edges}) == len(net.edges)
    keys = [n.key for n in generate(SALES, SALES.text_tables, 4)]
    assert len(keys) == len(set(keys))


def test_canonical_name_ignores_numbering():
    a = Network((("nation", False), ("customer", True), ("supplier", True)), (Edge(1, 0, 1), Edge(2, 0, 2)))
    b = Network((("supplier", True), ("nation", False), ("customer", True)), (Edge(2, 1, 1), Edge(0, 1, 2)))
    assert a.key == b.key and a.made() == b.made()


def test_star_allows_free_leaves():
    assert len(generate(SALES, ["customer"], 4, ["part"])) > len(generate(SALES, ["customer"], 4))


def test_index_fills_every_set():
    index = NetworkIndex(FILMS, 3).fill()
    assert len(index.found) == 3 and index.of(["genre"]) is index.of(["genre"])


def test_formulas():
    p = Params()
    assert damp(0) == 0 and damp(1) == 1 and math.isclose(damp(10), 1 + math.log(1 + math.log(10)))
    assert math.isclose(idf(3630, 303), 2.396093, abs_tol=1e-6) and idf(10, 6) < 0 and idf(2, 2) < 0
    assert math.isclose(size_weight(1, 1, 2, p), 1.0) and math.isclose(size_weight(4, 2, 2, p), 0.366667, abs_tol=1e-6)
    assert completeness(2, 2, p) == 0


def test_tokens_of():
    assert tokens_of("Red, red-PLATE x é 7") == ["red", "red", "plate", "é"]


def test_run_file():
    lines = ["K = 4", "DATASET=sales", "ALGS = 2 10", "OFFLINE_CN_SEARCH = false", "ALPHA = 1", "MAXCN = 5", "SERVER = here", "", "1 furniture widget", "2 +red"]
    c = read_config(lines)
    assert (c.k, c.algorithms, c.alpha, c.max_size, c.connection) == (4, ("global_pipeline", "tree_pipeline"), 1.0, 5, {"server": "here"})
    assert read_queries(lines) == [("1", "furniture widget"), ("2", "+red")]
    with pytest.raises(ValueError):
        read_config(["COLOUR = red"])


def test_spec_round_trip():
    assert SchemaSpec.from_json(SALES.to_json()) == SALES


def test_networks_of_other_schemas():
    """References to one table by two columns, from a table to itself, around a circle, and keys of several columns."""
    assert len(MONDIAL.fks) == 38 and len(MONDIAL.text_tables) == 16 and len(IMDB.fks) == 7 and len(IMDB.text_tables) == 7
    rivers = {n.key for n in generate(MONDIAL, ["river"], 3)}
    assert any(n.count("river*") == 2 for n in rivers)
    capitals = [n for n in generate(MONDIAL, ["city", "country"], 2) if n.size == 2]
    assert len(capitals) == 1 and len([n for n in generate(MONDIAL, ["country"], 3) if any(t == "borders" for t, _ in n.nodes)]) == 1
    assert len([n for n in generate(IMDB, ["movies", "actors"], 3) if n.size == 3]) >= 1 and set(BUILT_IN) == {"sales", "films", "bibliography", "imdb", "Mondial"}


def test_sides_of_a_cut_make_up_the_network():
    for net in generate(SALES, SALES.text_tables, 4):
        for e in net.edges:
            (a, at), (b, bt) = net.side(e, e.fk), net.side(e, e.pk)
            assert sorted(at + bt) == list(range(net.size)) and a.size + b.size == net.size
            assert [net.nodes[k] for k in at] == list(a.nodes) and [net.nodes[k] for k in bt] == list(b.nodes)
