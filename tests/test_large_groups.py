"""Networks in which many rows of a table refer to one row: results without its pairs and triples, against all trees."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.score import Params
from quillon.operators import nonfree, reports, topk
from quillon.operators.query import parse
from quillon.plans.joins import in_order
from quillon.sources.tables import Database
from quillon.spec import SALES

SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int", "customer": "c_custkey string, c_name string, c_mktsegment string, c_nationkey int",
    "supplier": "s_suppkey int, s_name string, s_nationkey int", "part": "p_partkey int, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey int, o_custkey string", "lineitem": "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int",
}
NATIONS = [(i, f"land{i}", 0) for i in range(3)]


def database(spark, customers):
    """Customers of a few nations; others hold no keyword."""
    rows = {"region": [(0, "north")], "nation": NATIONS, "customer": [*customers, *((f"x{i}", "none", "other", i % 3) for i in range(300))]}
    return Database(SALES, {t: spark.createDataFrame(rows.get(t, []), s).cache() for t, s in SCHEMAS.items()})


def customers_of(n, seed=2):
    """n customers in two nations; keys begin one another; some have a longer text, or both words."""
    r = random.Random(seed)
    return [(str(i), r.choice(["red", "red", "red", "red", "red old", "red blue"]), "", r.choice([0, 0, 0, 2])) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def many(spark):
    return database(spark, customers_of(60))


def planned(db, text="red blue", **how):
    s = topk.prepare(db, text, max_size=4, **how)
    return s, [n for n in s.networks if n.key.startswith("nation(<1customer*,<1customer*")]


@pytest.mark.parametrize("how", [{}, {"break_symmetry": False}, {"p": Params(method="virtual_document")}, {"p": Params(method="tuple_average")}], ids=["topk_one_plan", "topk_both_orders", "topk_score3", "topk_score1"])
def test_best_trees_of_large_groups(many, how):
    s, networks = planned(many, **how)
    assert [n.size for n in networks] == [3, 4]
    for n in networks:
        assert s.planner.top(n, 3).collect() == in_order(s.planner.scored(n)).limit(3).collect()
    s.close()


def joined_rows(spark, copies, k, **how):
    """Rows of the plan of the largest group's trees, before the k best are taken."""
    s, networks = planned(database(spark, [(f"{i:05}", "red", "", 0) for i in range(copies)]), "red", **how)
    n = max(networks, key=lambda n: n.size)
    rows = s.planner.rows(n, k=k).count()
    s.close()
    return rows


@pytest.mark.parametrize("how", [{}, {"break_symmetry": False}], ids=["topk_one_plan", "topk_both_orders"])
def test_no_more_rows_are_joined_for_more_copies(spark, how):
    """Trees joined don't grow with the cube of a group."""
    assert joined_rows(spark, 50, 2, **how) == joined_rows(spark, 100, 2, **how)


@pytest.mark.parametrize("how", [{}, {"break_symmetry": False}], ids=str)
def test_counted_trees_are_all_trees(many, how):
    """cn_scores: counts, best and worst without the trees."""
    s, networks = planned(many, **how)
    for n in networks:
        trees = s.planner.scored(n).agg(F.count("*"), F.max("score"), F.min("score")).first()
        assert [tuple(r)[1:] for r in s.planner.extremes(n).collect()] == [tuple(trees)]
        assert s.planner.counted(n).count() < trees[0] / 3
    s.close()


def test_counted_trees_where_rows_share_a_key(spark):
    """Keys that are no keys: rows of one key make no tree, so the trees are joined."""
    s, networks = planned(database(spark, [(str(i % 8), "red", "", 0) for i in range(12)]), "red")
    for n in networks:
        assert s.planner.extremes(n).first().n_trees == s.planner.scored(n).count() > 0
    s.close()


def test_idf_estimate_of_large_groups(many):
    """idf_estimate_error: the pairs counted, not joined."""
    s, networks = planned(many, "red")
    customers = many["customer"].collect()
    pairs = [(a, b) for a in customers for b in customers if a.c_nationkey == b.c_nationkey and a.c_custkey != b.c_custkey]
    with_it = sum("red" in a.c_name or "red" in b.c_name for a, b in pairs)
    found = reports.idf_estimate_error(s.planner, networks).first()
    assert (found.n_all, found.n_with) == (len(pairs), with_it)
    bare = reports.all_rows(s.planner)
    assert bare.counted(networks[0]).count() <= 4 * len(NATIONS)
    s.close()


def test_mean_error_of_large_groups(many):
    """idf_estimate_mean_error: over all size-3 networks of two keywords, from one count of classes each."""
    s, networks = planned(many)
    each = reports.idf_estimate_error(s.planner, networks)
    errors = [r.error for r in each.collect()]
    found = reports.mean_error(each).first()
    assert found.n == len(errors) == 2 and abs(found.mean_error - sum(errors) / 2) < 1e-12
    assert reports.all_rows(s.planner).counted(networks[0]).count() <= 16 * len(NATIONS)
    s.close()


def test_large_groups_are_shared_by_tasks(spark):
    """cn_size4_star, cn_size3_selfjoin, cn_symmetry_broken: all trees of one nation come from several tasks."""
    s, networks = planned(database(spark, [(str(i), "red", "", 0) for i in range(40)]), "red")
    for n, trees in zip(networks, (40 * 39 // 2, 40 * 39 * 38 // 6)):
        tasks = s.planner.scored(n).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == trees and len(tasks) > 4
    s.close()


def rows_of_joins(df):
    """Most rows that a join of the plan that ran made, of its last stage."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan"}.get(node.nodeName())
        todo += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("how", [{}, {"break_symmetry": False}], ids=["cn_symmetry_broken", "cn_size3_selfjoin"])
def test_trees_are_unfolded_from_lists(spark, how):
    """Joins meet lists of keys, not a row for each tree."""
    s, networks = planned(database(spark, [(str(i), "red", "", 0) for i in range(200)]), "red", **how)
    trees = s.planner.scored(networks[0])
    n = len(trees.collect())
    assert n == 200 * 199 / (1 if how else 2)
    assert 0 < rows_of_joins(trees) < n / 5
    s.close()


def rows_unfolded(df):
    """Rows that the plan that ran made of lists, of its last stage."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Generate":
            found.append(node.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan"}.get(node.nodeName())
        todo += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_no_more_is_unfolded_than_trees(spark):
    """cn_size3_selfjoin: lists lose a tree's own key before they are unfolded; no tree is tested by itself, and no column of one can be null."""
    s, networks = planned(database(spark, [(str(i), "red", "", 0) for i in range(200)]), "red", break_symmetry=False)
    trees = s.planner.scored(networks[0])
    assert len(trees.collect()) == 200 * 199
    assert rows_unfolded(trees) == [200 * 199]
    assert not any(f.nullable for f in s.planner.scored(networks[0], tf_text=True).schema)
    s.close()


def nodes_that_ran(df):
    """Nodes of the plan that ran, with those of all its stages; and how many Generates each piece of compiled code has."""
    todo, found, compiled = [(df._jdf.queryExecution().executedPlan(), None)], [], []
    while todo:
        node, code = todo.pop()
        found.append(node)
        if node.nodeName().startswith("WholeStageCodegen"):
            code = len(compiled)
            compiled.append(0)
        elif node.nodeName() == "InputAdapter":
            code = None
        elif node.nodeName() == "Generate" and code is not None:
            compiled[code] += 1
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}.get(node.nodeName())
        todo += [(getattr(node, inner)(), code)] if inner else [(node.children().apply(i), code) for i in range(node.children().size())]
    return found, compiled


@pytest.mark.parametrize("how", [{}, {"break_symmetry": False}], ids=str)
def test_pairs_of_three_rows_are_not_shuffled(spark, how):
    """cn_size4_star: lists of keys are shuffled, no row for each pair of a group; of the lists of a row one at a time is unfolded in compiled code, which keeps what it makes of a row."""
    s, networks = planned(database(spark, [(str(i), "red", "", 0) for i in range(60)]), "red", **how)
    trees = s.planner.scored(networks[1])
    assert len(trees.collect()) == 60 * 59 * 58 / (1 if how else 6)
    found, compiled = nodes_that_ran(trees)
    shuffled = [n.metrics().apply("shuffleRecordsWritten").value() for n in found if n.nodeName() == "Exchange"]
    assert 0 < max(shuffled) < 60 * 59 / 2 / 4
    assert max(compiled) == 1
    s.close()


@pytest.mark.parametrize("keys", [60, 8], ids=["own keys", "shared keys"])
def test_unfolded_trees_are_all_trees(spark, keys):
    """cn_size3_selfjoin: the same trees, as often, as by plain joins, also where rows share a key."""
    s, networks = planned(database(spark, [(str(int(k) % keys), *more) for k, *more in customers_of(24)]), break_symmetry=False)
    for n in networks:
        plain = s.planner.scored(n, s.planner.rows(n))
        assert sorted(map(tuple, s.planner.scored(n).collect())) == sorted(map(tuple, plain.collect())) != []
    s.close()


def test_few_large_parts_are_dealt_to_all_cores(spark, monkeypatch):
    """idf_estimate_mean_error, topk_both_orders: the words of a table of one file are parted by many tasks; statistics and rows are the same."""
    customers = spark.createDataFrame(customers_of(60), SCHEMAS["customer"]).coalesce(1)
    db = Database(SALES, {t: customers if t == "customer" else spark.createDataFrame(NATIONS if t == "nation" else [], s) for t, s in SCHEMAS.items()})
    found = []
    for limit in (1 << 80, 0):
        monkeypatch.setattr(nonfree, "DEALT_BYTES", limit, raising=False)
        rows = nonfree.scanned(db, "customer", parse("red blue"))
        s = topk.prepare(db, "red blue")
        found.append((sorted(map(tuple, s.planner.table("customer").collect())), s.planner.stats))
        s.close()
        assert rows.rdd.getNumPartitions() == (1 if limit else spark.sparkContext.defaultParallelism)
    assert found[0] == found[1] and len(found[0][0]) == 60
