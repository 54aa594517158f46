"""Top-k search over all networks of a query.

Every algorithm gives the same rows; they differ in what they run. Each runs units (a network, a network over blocks of
its keyword rows, or a join of two shared halves) in the order of an upper bound, and stops once the kth score is over
the bound of all that is left; so the driver holds k rows and the units' bounds.

sparse            whole networks.
two_level_bound   a network that comes up first is bounded once more, by the best of the combinations of tf that its rows
                  really have, and goes back among the others before it runs.
global_pipeline   keyword rows in blocks by score; the best network takes one more block of one node, joined to the blocks
                  that the other nodes have taken already.
queue_pipeline    one combination of blocks at a time; its neighbours enter the queue when it has run.
tree_pipeline     a network is cut at the edge whose halves most networks share; halves are joined once and kept, and a
                  network with an empty half isn't run.

search_plan() is the exhaustive form, one lazy plan.
"""

from __future__ import annotations

import heapq
import itertools
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.score import Params
from ..plans.joins import RESULT, Planner, Ranges, in_order
from ..plans.networks import Edge, Network, NetworkIndex, generate
from ..sources.tables import Database
from .index import WordIndex
from .nonfree import KeywordRows
from .query import KeywordQuery, parse

#: Rows of a node's first block; each further one is twice as large. Blocks end with the last row of a score.
BLOCK = 64
#: Most tf vectors of a table, and combinations of them, that a tight bound looks at; with more the first bound stays.
VECTORS, COMBINATIONS = 2000, 200_000
ALGORITHMS = ("sparse", "global_pipeline", "queue_pipeline", "two_level_bound", "tree_pipeline")


@dataclass
class Search:
    """A query that is planned: its statistics, networks, and plans. close() deletes the keyword rows."""

    planner: Planner | None
    networks: list[Network]
    metrics: dict[str, float] = field(default_factory=dict)

    def close(self) -> None:
        if self.planner:
            self.planner.close()


def prepare(
    db: Database, text: str | KeywordQuery, max_size: int = 4, p: Params = Params(), index: NetworkIndex | None = None, strict: bool = False, break_symmetry: bool = True, and_mode: str = "filter",
    words: WordIndex | None = None,
) -> Search:
    """words: an inverted index, which is probed instead of scanning the text tables."""
    began = time.perf_counter()
    query = parse(text) if isinstance(text, str) else text
    rows = KeywordRows(db, query, strict, words) if query else None
    if rows is None or rows.stats is None:
        if rows:
            rows.drop()
        return Search(None, [])
    counted, stats = time.perf_counter(), rows.stats
    stars = stats.query.stars
    networks = index.of(stats.tables, stars) if index else generate(db.spec, stats.tables, max_size, stars)
    if stats.query.network is not None:
        networks = networks[stats.query.network : stats.query.network + 1]
    return Search(Planner(db, stats, p, break_symmetry, and_mode, rows), networks, {"statistics_s": counted - began, "networks_s": time.perf_counter() - counted, "networks": len(networks)})


def nothing(db: Database) -> DataFrame:
    return db.spark.createDataFrame([], RESULT)


def order_key(r: Row) -> tuple:
    return (-r.score, r.cn_size, r.cn_key, r.node_keys)


def search_plan(db: Database, text: str, k: int = 10, **how) -> DataFrame:
    """All networks in one plan, which reads the keyword rows when it runs: their folder stays, as a checkpoint does."""
    s = prepare(db, text, **how)
    if not s.networks:
        return nothing(db)
    return in_order(reduce(DataFrame.unionByName, [s.planner.top(n, k) for n in s.networks])).limit(k)


@dataclass(frozen=True)
class Block:
    """Rows first to last of a table by score; tops: the largest tf of each keyword in these rows or any after them."""

    first: int
    last: int
    tops: tuple[int, ...]


class Units:
    """What an algorithm runs next: next() gives a bound and a plan of RESULT rows, in falling order of the bound; peek() the bound of all that is left."""

    def __init__(self, s: Search, k: int):
        self.s, self.planner, self.k = s, s.planner, k
        self.heap: list[tuple[float, int, tuple, int, object]] = []
        self.number = itertools.count()
        self.rows_in = 0
        held = {n.key: sum(self.planner.stats.n_nonfree[t] for t, h in n.nodes if h) for n in s.networks}
        for n in s.networks:
            self.push(self.planner.bound(n), n, (n.size, held[n.key], n.key), self.first(n))

    def first(self, net: Network) -> object:
        return None

    def push(self, bound: float, net: Network, order: tuple, what: object) -> None:
        heapq.heappush(self.heap, (-bound, order[0], order[1:], next(self.number), (net, order, what)))

    def peek(self) -> float:
        return -self.heap[0][0] if self.heap else float("-inf")

    def next(self) -> DataFrame | None:
        """The best unit's plan; None if it was only bounded anew, or is empty."""
        bound, *_, (net, order, what) = heapq.heappop(self.heap)
        return self.run(-bound, net, order, what)

    def run(self, bound: float, net: Network, order: tuple, what: object) -> DataFrame | None:
        return self.whole(net)

    def whole(self, net: Network, rows: DataFrame | None = None) -> DataFrame:
        self.rows_in += sum(self.planner.stats.n_nonfree[t] for t, h in net.nodes if h)
        return self.planner.top(net, self.k, rows)


class TwoLevel(Units):
    def run(self, bound, net, order, what):
        if what == "tight":
            return self.whole(net)
        self.push(min(bound, self.tight(net)), net, order, "tight")
        return None

    def vectors(self, table: str) -> list[tuple[int, ...]] | None:
        """Distinct tf of a table's keyword rows that no other exceeds in all keywords; None if there are too many."""
        if table not in self.__dict__.setdefault("known", {}):
            found = [tuple(r.tf) for r in self.planner.table(table).select("tf").distinct().limit(VECTORS + 1).collect()]
            best = [v for v in found if not any(v != w and all(x <= y for x, y in zip(v, w)) for w in found)]
            self.known[table] = None if len(found) > VECTORS else best
        return self.known[table]

    def tight(self, net: Network) -> float:
        """The largest bound of any combination of vectors: scores grow with every tf, if no idf is negative."""
        each = [self.vectors(t) for t, h in net.nodes if h]
        n = 1
        for v in each:
            n *= len(v) if v else 0
        if None in each or n > COMBINATIONS or min(self.planner.stats.idfs) < 0 or self.planner.weight(net) <= 0:
            return float("inf")
        sums = {tuple(map(sum, zip(*c))) for c in itertools.product(*each)}
        return max((self.planner.bound(net, [list(v)]) for v in sums), default=float("-inf"))


class Blocks(Units):
    """Blocks of the nodes' tables, by their rows' order of score."""

    def blocks(self, table: str) -> list[Block]:
        if table not in self.__dict__.setdefault("cut", {}):
            n, step = len(self.planner.stats.keywords), F.greatest(F.ceil(F.log2(F.col("block") / F.lit(float(max(BLOCK, self.k))))), F.lit(0))
            rows = self.planner.numbered(table).groupBy(step.alias("b")).agg(F.min("row_n").alias("first"), F.max("row_n").alias("last"), F.array(*[F.max(F.col("tf")[i]) for i in range(n)]).alias("top")).orderBy("first").collect()
            made, top = [], (0,) * n
            for r in reversed(rows):
                top = tuple(map(max, top, r.top))
                made.append(Block(r.first, r["last"], top))
            self.cut[table] = made[::-1]
        return self.cut[table]

    def held(self, net: Network) -> list[tuple[int, list[Block]]]:
        return [(k, self.blocks(t)) for k, (t, h) in enumerate(net.nodes) if h]

    def over(self, net: Network, ranges: Ranges) -> DataFrame:
        self.rows_in += sum(b - a + 1 for a, b in ranges.values())
        return self.planner.top(net, self.k, self.planner.rows(net, ranges, self.k))


class QueuePipeline(Blocks):
    """what: a block of each node, and the node that was moved last, so that each combination is reached once."""

    def run(self, bound, net, order, what):
        held = self.held(net)
        if any(not b for _, b in held):
            return None
        at, last = what or ((0,) * len(held), 0)
        for i in range(last, len(held)):
            if at[i] + 1 < len(held[i][1]):
                new = (*at[:i], at[i] + 1, *at[i + 1 :])
                self.push(min(bound, self.planner.bound(net, [list(b[j].tops) for (_, b), j in zip(held, new)])), net, order, (new, i))
        return self.over(net, {k: (b[j].first, b[j].last) for (k, b), j in zip(held, at)})


class GlobalPipeline(Blocks):
    """what: how many blocks each node has taken."""

    def run(self, bound, net, order, what):
        held = self.held(net)
        if any(not b for _, b in held):
            return None
        if what is None:
            taken, ranges = [1] * len(held), {k: (b[0].first, b[0].last) for k, b in held}
        else:
            taken, i = list(what[0]), what[1]
            ranges = {k: (b[0].first, b[n - 1].last) for (k, b), n in zip(held, taken)}
            k, b = held[i]
            ranges[k] = (b[taken[i]].first, b[taken[i]].last)
            taken[i] += 1
        left = [(self.planner.bound(net, [list((b[taken[j]] if i == j else b[0]).tops) for j, (_, b) in enumerate(held)]), i) for i in range(len(held)) if taken[i] < len(held[i][1])]
        if left:
            best, i = max(left, key=lambda x: (x[0], -x[1]))
            self.push(min(bound, best), net, order, (tuple(taken), i))
        return self.over(net, ranges)


class TreePipeline(Units):
    def __init__(self, s: Search, k: int):
        super().__init__(s, k)
        self.shared: Counter = Counter(h for n in s.networks for h in {h for a, b, _ in n.cuts() for h in (a, b)})
        self.kept: dict[str, DataFrame | None] = {}

    def run(self, bound, net, order, what):
        if any(self.kept.get(h, 1) is None for a, b, _ in net.cuts() for h in (a, b)):
            return None  # a half has no rows
        edge = max(net.cuts(), key=lambda c: (sum(h in self.kept for h in c[:2]), min(self.shared[h] for h in c[:2]), -c[2].key, -c[2].fk), default=None)
        if edge is None or max(self.shared[h] for h in edge[:2]) < 2:
            return self.whole(net)
        halves = [self.half(net, edge[2], node) for node in (edge[2].fk, edge[2].pk)]
        if any(h is None for h in halves):
            return None
        return self.whole(net, self.planner.from_halves(net, edge[2], halves))

    def half(self, net: Network, edge: Edge, node: int) -> tuple[DataFrame, list[int]] | None:
        """The rows of a half, kept if another network shares it; None if there are none."""
        half, at = net.side(edge, node)
        name = net.name(node, edge.fk + edge.pk - node)
        if self.shared[name] < 2:
            return self.planner.joined(half), at
        if name not in self.kept:
            df = self.planner.joined(half).persist()
            self.kept[name] = None if df.isEmpty() else df
        return (self.kept[name], at) if self.kept[name] is not None else None

    def close(self) -> None:
        for df in self.kept.values():
            if df is not None:
                df.unpersist()


UNITS = {"sparse": Units, "two_level_bound": TwoLevel, "queue_pipeline": QueuePipeline, "global_pipeline": GlobalPipeline, "tree_pipeline": TreePipeline}


def results(s: Search, k: int, algorithm: str = "sparse", timeout: float | None = None) -> Iterator[Row]:
    """The k best rows in order, each as soon as nothing that is left can beat it; then s is closed. After timeout seconds running jobs are cancelled, and the best rows so far end the search (metrics["timed_out"])."""
    if algorithm not in UNITS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    if s.planner is None:
        return
    top: list[Row] = []
    given, run, began, units = 0, 0, time.perf_counter(), None
    context, group, late = s.planner.db.spark.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop) if timeout is not None else None
    try:
        if timer:
            context.setJobGroup(group, "keyword search", interruptOnCancel=True)
            timer.daemon = True
            timer.start()
        try:
            units = UNITS[algorithm](s, k)
            while units.heap and not late.is_set() and not (len(top) >= k and top[k - 1].score > units.peek()):
                plan = units.next()
                if plan is not None:
                    top = sorted([*top, *plan.collect()], key=order_key)[:k]
                    run += 1
                while given < len(top) and top[given].score > units.peek():
                    yield top[given]
                    given += 1
        except (PySparkException, Py4JJavaError):
            if not late.is_set():
                raise
        left = {u[-1][0].key for u in units.heap} if units else set()
        s.metrics |= {"run": run, "pruned": len(left), "rows_in": units.rows_in if units else 0, "timed_out": float(late.is_set()), "search_s": time.perf_counter() - began, "kth_score": top[-1].score if top else 0.0}
        yield from top[given:]
    finally:
        if timer:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if isinstance(units, TreePipeline):
            units.close()
        s.close()


def search(db: Database, text: str, k: int = 10, algorithm: str = "sparse", timeout: float | None = None, **how) -> DataFrame:
    """The k best trees: score, cn_size, cn_key, node_keys, dl, tf."""
    rows = list(results(prepare(db, text, **how), k, algorithm, timeout))
    return in_order(db.spark.createDataFrame(rows, RESULT)) if rows else nothing(db)


def search_with_texts(db: Database, text: str, k: int = 10, **how) -> DataFrame:
    """The k best trees with their nodes' texts: the k rows are joined back, network by network."""
    s = prepare(db, text, **how)
    rows = list(results(s, k))
    parts = []
    for n in s.networks:
        if own := [r for r in rows if r.cn_key == n.key]:
            parts.append(s.planner.texts(db.spark.createDataFrame(own, RESULT), n))
    empty = nothing(db).withColumn("nodes", F.array().cast("array<struct<tbl:string,key:string,text:string>>"))
    return in_order(reduce(DataFrame.unionByName, parts)) if parts else empty
