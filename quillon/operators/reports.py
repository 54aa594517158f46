"""Statistics, plans and diagnostics as DataFrames."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import idf, idf_plus_one, idf_separate
from ..plans.joins import Planner
from ..plans.networks import Network, generate
from ..sources.tables import Database
from ..spec import SchemaSpec
from .nonfree import Stats, nonfree, scanned
from .topk import prepare, results


def df_by_table(db: Database, stats: Stats) -> DataFrame:
    """keyword, tbl, df, selectivity."""
    rows = [(str(k), t, stats.df[t, k], stats.df[t, k] / n) for k in stats.keywords for t, n in stats.sizes.items() if n]
    return db.spark.createDataFrame(rows, "keyword string, tbl string, df long, selectivity double")


def idf_report(db: Database, stats: Stats) -> DataFrame:
    """keyword, df, idf, idf_plus_one, idf_separate."""
    rows = []
    for i, k in enumerate(stats.keywords):
        df = stats.total_df[k]
        own = {t: stats.df[t, k] / n for t, n in stats.sizes.items() if stats.df[t, k]}
        rows.append((str(k), df, idf(stats.n, df, i), idf_plus_one(stats.n, df), idf_separate(own)))
    return db.spark.createDataFrame(rows, "keyword string, df long, idf double, idf_plus_one double, idf_separate double")


def extremes(db: Database, stats: Stats) -> DataFrame:
    """tbl, n_nonfree, min_score, max_score, selectivity of the tables with keyword rows."""
    parts = []
    for t in stats.tables:
        nf = nonfree(db, t, stats)
        parts.append(nf.agg(F.lit(t).alias("tbl"), F.count("*").alias("n_nonfree"), F.min("score").alias("min_score"), F.max("score").alias("max_score")).withColumn("selectivity", F.col("n_nonfree") / F.lit(float(stats.sizes[t]))))
    return reduce(DataFrame.unionByName, parts)


def network_catalog(planner: Planner, networks: list[Network]) -> DataFrame:
    """cn_no, cn_key, cn_size, n_nonfree, weight, bound."""
    rows = [(i, n.key, n.size, n.nonfree, planner.weight(n), planner.bound(n)) for i, n in enumerate(networks)]
    return planner.db.spark.createDataFrame(rows, "cn_no int, cn_key string, cn_size int, n_nonfree int, weight double, bound double")


def all_rows(planner: Planner) -> Planner:
    """A planner whose nodes with keywords are all rows of their tables, by which keywords they hold; not by length, so that most rows are alike."""
    bare = Planner(planner.db, planner.stats, planner.p, break_symmetry=False)
    for t in planner.stats.sizes:
        rows = scanned(planner.db, t, planner.stats.query).where(~F.col("bad")).drop("bad")
        bare.nf[t] = rows.withColumns({"tf": F.transform("tf", lambda c: (c > 0).cast("int")), "dl": F.lit(0)})
    return bare


def idf_estimate_error(planner: Planner, networks: list[Network]) -> DataFrame:
    """For networks of size 3: trees with any rows, with the keyword, the idf that gives, the estimate from independent selectivities, and the relative error."""
    s, out, bare = planner.stats, [], all_rows(planner)
    for n in networks:
        if n.size != 3:
            continue
        held = [i for i, (_, holds) in enumerate(n.nodes) if holds]
        tables = [n.nodes[i][0] for i in held]
        hit = [reduce(lambda a, b: a | b, [F.col(f"t{i}_tf")[j] > 0 for i in held]) for j in range(len(s.keywords))]
        n_all, *hits = bare.counted(n).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n"), *[F.when(h, F.col("n")) for h in hit])]).first()
        for k, with_it in zip(s.keywords, hits):
            if n_all and all(s.df[t, k] for t in tables):
                true = math.log(n_all / with_it) if with_it else None
                estimate = math.log(1 / (1 - math.prod(1 - s.df[t, k] / s.sizes[t] for t in tables)))
                out.append((n.key, str(k), n_all, with_it, true, estimate, abs(estimate - true) / true if true else None))
    return planner.db.spark.createDataFrame(out, "cn_key string, keyword string, n_all long, n_with long, idf double, estimate double, error double")


def workload(dictionary: DataFrame, draws: DataFrame) -> DataFrame:
    """draws: query long, draw long, at double in [0, 1). Each draw takes the word whose share of occurrences holds it; a query's words come in the order of the dictionary.

    Running sums go by first letters and then within them, so no single task sorts the dictionary. A draw is told its
    letters first (a table of one row a pair of letters), and meets the words of those letters only.
    """
    words = dictionary.select("word", "occurrences", F.substring("word", 1, 2).alias("part"))
    parts = words.groupBy("part").agg(F.sum("occurrences").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each pair of letters
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    total = parts.agg(F.sum("n")).first()[0] or 0
    small = F.broadcast(parts.select("part", "before", "n"))  # one row a pair of letters
    placed = draws.select("query", "draw", F.floor(F.col("at") * F.lit(total)).alias("place"))
    placed = placed.join(small, (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select("query", "draw", "place", "part")
    within = Window.partitionBy("part").orderBy("word")
    ranged = words.join(small.drop("n"), "part").withColumn("high", F.col("before") + F.sum("occurrences").over(within))
    hit = ranged.join(placed, "part").where((F.col("place") >= F.col("high") - F.col("occurrences")) & (F.col("place") < F.col("high")))
    return hit.select("query", "draw", "word")


def mean_error(estimates: DataFrame) -> DataFrame:
    """n, mean_error of idf_estimate_error()."""
    return estimates.agg(F.count("error").alias("n"), F.avg("error").alias("mean_error"))


def compare_algorithms(db: Database, text: str, k: int = 10, algorithms: tuple[str, ...] = ("sparse", "global_pipeline", "queue_pipeline", "two_level_bound", "tree_pipeline"), **how) -> DataFrame:
    """algorithm, networks, run, pruned, kth_score, seconds: the same query by each; equal kth scores are the check."""
    out = []
    for a in algorithms:
        s = prepare(db, text, **how)
        rows = list(results(s, k, a))
        m = s.metrics
        out.append((a, len(s.networks), int(m.get("run", 0)), int(m.get("pruned", 0)), rows[-1].score if rows else None, sum(v for n, v in m.items() if n.endswith("_s"))))
    return db.spark.createDataFrame(out, "algorithm string, networks int, run int, pruned int, kth_score double, seconds double")


def network_timings(spec: SchemaSpec, max_size: int) -> Iterator[str]:
    """Lines 'size milliseconds networks' of generating all networks, for sizes from 3 up."""
    for m in range(3, max_size + 1):
        began = time.perf_counter()
        n = len(generate(spec, spec.text_tables, m))
        yield f"{m} {1000 * (time.perf_counter() - began):.0f} {n}"
