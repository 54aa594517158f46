"""Networks to DataFrames: a chain of inner joins, distinct rows of a table, one order of equal subtrees, the score."""

from __future__ import annotations

import math
from collections.abc import Container, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import Params, size_weight, tree_score, upper_bound
from ..functions.text import row_text
from ..operators.index import identity
from ..operators.nonfree import KeywordRows, Stats, free, nonfree, ranked
from ..operators.query import AND
from ..sources.tables import Database
from .networks import Edge, Network

RESULT = "score double, cn_size int, cn_key string, node_keys string, dl int, tf array<int>"


Ranges = dict[int, tuple[int, int]]

#: Parts that the rows of a leaf are dealt to where they meet others of one bunch, so that a large group isn't one task's.
SALTS = 16


class Planner:
    """Frames of a query's nodes, shared by its networks: keyword rows as they were written once (rows), or scanned where there are none."""

    def __init__(self, db: Database, stats: Stats, p: Params = Params(), break_symmetry: bool = True, and_mode: str = "filter", rows: KeywordRows | None = None):
        self.db, self.stats, self.p, self.break_symmetry, self.and_mode, self.keyword_rows = db, stats, p, break_symmetry, and_mode, rows
        self.nf: dict[str, DataFrame] = {}
        self.in_order: dict[str, DataFrame] = {}
        self.lengths: dict[tuple[str, bool], int] = {}
        self.repeats: dict[tuple[str, bool], bool] = {}

    def table(self, table: str) -> DataFrame:
        return self.nf.setdefault(table, self.keyword_rows[table] if self.keyword_rows else nonfree(self.db, table, self.stats, self.p))

    def numbered(self, table: str) -> DataFrame:
        """Keyword rows with row_n by score and block, numbered once a search."""
        if table not in self.in_order:
            self.in_order[table] = ranked(self.table(table)).persist()
        return self.in_order[table]

    def node(self, k: int, table: str, holds: bool, rows: tuple[int, int] | None = None, least: tuple[str, int] | None = None, by: str | None = None) -> DataFrame:
        """Columns prefixed by the node's number, so that self-joins don't clash. rows: the first and last row_n that take part. least: a join column and how many of the least keys take part, of the rows that are alike in it and what is scored. by: a join column; rows that are alike are one row then, n of them."""
        if holds:
            df = self.numbered(table).where(F.col("row_n").between(*rows)).drop("row_n", "block") if rows else self.table(table)
        else:
            df = free(self.db, table, self.stats.query)
        if least:
            alike = Window.partitionBy(least[0], *(("tf", "dl") if holds else ())).orderBy("key")
            df = df.withColumn("_rank", F.dense_rank().over(alike)).where(F.col("_rank") <= least[1]).drop("_rank")
        if by:
            df = df.groupBy(by, *(("tf", "dl") if holds else ())).agg(F.count("*").alias("n"))
        return df.select(*[F.col(c).alias(f"t{k}_{c}") for c in df.columns])

    def longest(self, table: str, holds: bool) -> int:
        """Characters of the longest key of a node's rows."""
        if holds and self.keyword_rows:
            return self.keyword_rows.longest[table]
        if (table, holds) not in self.lengths:
            rows = self.table(table) if holds else free(self.db, table, self.stats.query)
            self.lengths[table, holds] = rows.agg(F.max(F.length("key"))).first()[0] or 0
        return self.lengths[table, holds]

    def close(self) -> None:
        for df in self.in_order.values():
            df.unpersist()
        if self.keyword_rows:
            self.keyword_rows.drop()

    def weight(self, net: Network) -> float:
        return size_weight(net.size, net.nonfree, len(self.stats.keywords), self.p)

    def matched(self, net: Network) -> int:
        tables = {t for t, holds in net.nodes if holds}
        return sum(any(self.stats.df[t, k] for t in tables) for k in self.stats.keywords)

    def bound(self, net: Network, tops: list[list[int]] | None = None) -> float:
        """No tree scores more, rounded as scores are. tops: the largest tfs of the rows that take part, for each node with keywords; those of whole tables unless given."""
        s = self.stats
        if self.p.method != "damped":
            return float("inf")
        matched = len(s.keywords) if self.p.soft_missing else self.matched(net) if tops is None else sum(any(t[i] for t in tops) for i in range(len(s.keywords)))
        tops = tops or [[s.max_tf[t, k] for k in s.keywords] for t, holds in net.nodes if holds]
        return round(upper_bound(tops, s.idfs, self.weight(net), matched, self.p), 9)

    def distinct_rows(self, net: Network, old: int, new: int) -> list[Column]:
        """No row stands twice in a tree."""
        same = net.nodes[old][0] == net.nodes[new][0] and self.db.spec.by_name[net.nodes[new][0]].pk
        return [F.col(f"t{old}_key") != F.col(f"t{new}_key")] if same else []

    def one_order(self, net: Network, df: DataFrame, without: Container[int] = ()) -> DataFrame:
        for a, b in net.twins() if self.break_symmetry else ():
            if a[0] in without:
                continue
            df = df.where(F.struct(*[F.col(f"t{k}_key") for k in a]) < F.struct(*[F.col(f"t{k}_key") for k in b]))
        return df

    def on(self, e: Edge) -> Column:
        f = self.db.spec.fks[e.key]
        return F.col(f"t{e.fk}_{f.fk_col}") == F.col(f"t{e.pk}_{f.pk_col}")

    def repeated(self, table: str, holds: bool) -> bool:
        """Whether rows of a node share a key, which keys don't allow."""
        if (table, holds) not in self.repeats:
            rows = self.table(table) if holds else free(self.db, table, self.stats.query)
            self.repeats[table, holds] = not rows.groupBy("key").count().where("count > 1").isEmpty()
        return self.repeats[table, holds]

    def bunches(self, net: Network) -> list[tuple[str, list[int]]]:
        """Leaves that refer to their neighbour, with the join column; those that are alike beside one another are together. Many rows of such a leaf meet one row.

        Leaves within larger subtrees of which one order counts are left out: their keys can decide that order.
        """
        found: dict[tuple, list[int]] = {}
        ordered = {k for a, b in net.twins() if len(a) > 1 for k in (*a, *b)}
        for e in net.edges:
            if len(net.around[e.fk]) == 1 and e.fk not in ordered:
                found.setdefault((e.pk, e.key, net.nodes[e.fk]), []).append(e.fk)
        return [(self.db.spec.fks[key].fk_col, sorted(leaves)) for (_, key, _), leaves in found.items()]

    def least(self, net: Network, k: int) -> dict[int, tuple[str, int]]:
        """For each leaf of bunches() the column, and how many least keys of a class (rows alike in column, tf and dl) hold all that the k best trees need.

        Put another row of its class, with a lesser key, for a row of a tree: the score stays, and node_keys gets less, unless the
        row stands in the tree already (as one of the other rows of its table), or its key begins the key of a row of the bunch
        ('1|' comes after '12|'), which at most as many keys do as these have characters. With k more lesser keys than that in
        its class a row is in none of the k best trees.
        """
        out = {}
        for column, leaves in self.bunches(net):
            table, holds = net.nodes[leaves[0]]
            others = sum(t == table for t, _ in net.nodes) - 1
            out |= dict.fromkeys(leaves, (column, k + others + len(leaves) * self.longest(table, holds)))
        return out

    def joined(self, net: Network, ranges: Ranges | None = None, least: dict[int, tuple[str, int]] | None = None, by: dict[int, str] | None = None) -> DataFrame:
        """The trees with every node's columns, equal subtrees in both orders. Joins start from the node with the fewest keyword rows and go outward."""
        s, ranges, least, by = self.stats, ranges or {}, least or {}, by or {}
        first = min(range(net.size), key=lambda k: (s.n_nonfree.get(net.nodes[k][0], 0), k) if net.nodes[k][1] else (1 << 62, k))
        df, joined, todo = self.node(first, *net.nodes[first], ranges.get(first), least.get(first), by.get(first)), [first], list(net.edges)
        while todo:
            e = next(e for e in todo if e.fk in joined or e.pk in joined)
            todo.remove(e)
            new = e.pk if e.fk in joined else e.fk
            on = [self.on(e), *[c for old in joined if new not in by and old not in by for c in self.distinct_rows(net, old, new)]]
            df = df.join(self.node(new, *net.nodes[new], ranges.get(new), least.get(new), by.get(new)), reduce(Column.__and__, on))
            joined.append(new)
        return df

    def rows(self, net: Network, ranges: Ranges | None = None, k: int | None = None) -> DataFrame:
        """The trees, one order of equal subtrees. k: no more rows of a leaf than the k best trees need."""
        return self.one_order(net, self.joined(net, ranges, self.least(net, k) if k else None))

    def counted(self, net: Network) -> DataFrame:
        """The trees, those that differ in the keys of alike leaves only as one row; n: how many there are. Nothing is larger than the classes of such leaves.

        Leaves of one table are counted if they are all of that table in the tree and its keys are its rows' own; the others are joined as in rows().
        """
        tables = [t for t, _ in net.nodes]
        bunches = []
        for column, leaves in self.bunches(net):
            table, holds = net.nodes[leaves[0]]
            alone = len(leaves) == tables.count(table)
            if alone and (len(leaves) == 1 or self.db.spec.by_name[table].pk and not self.repeated(table, holds)):
                bunches.append((column, leaves))
        by = {k: column for column, leaves in bunches for k in leaves}
        df, n = self.one_order(net, self.joined(net, by=by), by), F.lit(1).cast("long")
        for _, leaves in bunches:
            values = {k: F.struct(F.col(f"t{k}_tf"), F.col(f"t{k}_dl")) if net.nodes[k][1] else F.lit(0) for k in leaves}
            for i, k in enumerate(leaves):
                taken = reduce(Column.__add__, [(values[j] == values[k]).cast("long") for j in leaves[:i]], F.lit(0).cast("long"))
                n = n * F.greatest(F.col(f"t{k}_n") - taken, F.lit(0))
                if self.break_symmetry and i:  # classes in order: of r rows of one class, n over r sets
                    n = F.call_function("div", n, taken + 1)
                    df = df.where(values[leaves[i - 1]] <= values[k])
        return df.withColumn("n", n).where("n > 0")

    def from_halves(self, net: Network, edge: Edge, halves: list[tuple[DataFrame, list[int]]]) -> DataFrame:
        """The trees of net from those of its two sides of an edge; each half is a frame of a made() network and the nodes of net that its nodes are."""
        frames = []
        for df, at in halves:
            names = {f"t{k}": f"t{n}" for k, n in enumerate(at)}
            frames.append(df.select(*[F.col(c).alias(names[c.split("_", 1)[0]] + "_" + c.split("_", 1)[1]) for c in df.columns]))
        on = [self.on(edge), *[c for a in halves[0][1] for b in halves[1][1] for c in self.distinct_rows(net, a, b)]]
        return self.one_order(net, frames[0].join(frames[1], reduce(Column.__and__, on)))

    def rated(self, net: Network, df: DataFrame) -> tuple[DataFrame, Column, Column, list[Column]]:
        """Trees that hold all and keywords; their score, dl and tfs."""
        s, held = self.stats, [k for k, (_, holds) in enumerate(net.nodes) if holds]
        tfs = [reduce(Column.__add__, [F.col(f"t{k}_tf")[i] for k in held]) for i in range(len(s.keywords))]
        dl = reduce(Column.__add__, [F.col(f"t{k}_dl") for k in held])
        if self.and_mode == "filter":
            for i, k in enumerate(s.keywords):
                if k.group == AND:
                    df = df.where(tfs[i] > 0)
        return df, F.round(self.score(net, held, tfs, dl), 9), dl, tfs

    def scored(self, net: Network, rows: DataFrame | None = None, tf_text: bool = False) -> DataFrame:
        """RESULT columns of all trees of a network; and keywords must all be there. tf_text: tf as text, joined by commas."""
        several = {k: (column, leaves) for column, leaves in self.bunches(net) if len(leaves) > 1 for k in leaves} if rows is None else {}
        if several:
            rows = self.one_order(net, self.joined(net, by={k: column for k, (column, _) in several.items()}), several)
        df, score, dl, tfs = self.rated(net, self.rows(net) if rows is None else rows)
        tf = F.concat_ws(",", *[t.cast("string") for t in tfs]) if tf_text else F.array(*tfs)
        df = df.withColumns({"score": score, "dl": dl.cast("int"), "tf": tf})
        if several:
            # they never are null; where Spark knows that, it does less for each tree that is written
            df = df.withColumns({"score": F.coalesce("score", F.lit(0.0)), "dl": F.coalesce("dl", F.lit(0))})
            df = self.expanded(net, df, several)
        else:
            df = df.withColumn("node_keys", F.concat(*self.labelled(net, range(net.size))))
        return df.select("score", F.lit(net.size).alias("cn_size"), F.lit(net.key).alias("cn_key"), "node_keys", "dl", "tf")

    def label(self, net: Network, k: int) -> str:
        """What stands before a node's key in node_keys."""
        return f"{'|' if k else ''}{net.nodes[k][0]}:"

    def labelled(self, net: Network, nodes: Iterable[int]) -> list[Column]:
        return [c for k in nodes for c in (F.lit(self.label(net, k)), F.col(f"t{k}_key"))]

    def expanded(self, net: Network, df: DataFrame, several: dict[int, tuple[str, list[int]]]) -> DataFrame:
        """The trees of rows of classes, which are scored already, with node_keys. Each leaf's rows are joined by its class, as lists of keys, which are unfolded after the last join; the first of two leaves before it.

        So what is shuffled grows with the rows of one leaf, not with pairs of rows. Rows that meet lists are dealt to SALTS
        parts of a class, so that tasks share large groups. What stands before and after the last leaf's key is put together
        before it is unfolded, so that little is done for each tree.
        """
        spark = self.db.spark
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        made, before = [k for k in range(net.size) if k not in several], self.before(net)
        df = df.select("score", "dl", "tf", *[f"t{k}_key" for k in made], *[f"t{k}_{c}" for k in several for c in self.alike(net, k, several)])
        first, folded = next(iter(several)), []
        for k in several:
            on, lists = [f"t{k}_{c}" for c in self.alike(net, k, several)], self.lists(net, k, several)
            if k != first:
                lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                dealt = reduce(Column.__add__, [F.col(f"_part{j}") for j in folded]) if folded else F.xxhash64(f"t{first}_key")
                df = df.withColumn("_salt", F.pmod(dealt, F.lit(SALTS)).cast("int"))
                on.append("_salt")
                lists, df = lists.repartition(parts, *on), df.repartition(parts, *on)
            # sorted, as the lists are larger than their tables' sizes tell: not to be broadcast
            own = lists.withColumnsRenamed({c: f"_{c}" for c in on}).hint("merge")
            after = [(F.element_at(f"_keys{j}", 1) if j in folded else F.col(f"t{j}_key")) < F.element_at(f"_keys{k}", -1) for j in before[k][-1:]]
            df = df.join(own, reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in on] + after)).drop(*on, *[f"_{c}" for c in on])
            folded.append(k)
            if k == first and len(several) == 2:
                df = self.unfolded(net, df, folded.pop(), made)
        for k in folded[:-1]:
            df = self.unfolded(net, df, k, made)
        k = folded[-1]
        df = df.select("score", "dl", "tf", f"_keys{k}", F.coalesce(F.concat(*self.labelled(net, range(k)), F.lit(self.label(net, k))), F.lit("")).alias("_head"), *([F.concat(*self.labelled(net, range(k + 1, net.size))).alias("_tail")] if k + 1 < net.size else []), *[f"t{j}_key" for j in made if j == made[-1] or net.nodes[j][0] == net.nodes[k][0]])
        return self.unfolded(net, df, k, made, last=True).withColumn("node_keys", F.concat("_head", f"t{k}_key", *(["_tail"] if k + 1 < net.size else [])))

    def lists(self, net: Network, k: int, several: dict[int, tuple[str, list[int]]]) -> DataFrame:
        """A leaf's keys by class, in SALTS sorted lists that follow one another (fewer in a class of fewer rows): those that can hold a key, or greater ones, are told by their ends."""
        on, key = [f"t{k}_{c}" for c in self.alike(net, k, several)], F.col(f"t{k}_key")
        leaf = self.node(k, *net.nodes[k]).select(*on, key, F.ntile(SALTS).over(Window.partitionBy(*on).orderBy(key)).alias(f"_part{k}"))
        return leaf.groupBy(*on, f"_part{k}").agg(F.sort_array(F.collect_list(key)).alias(f"_keys{k}"))

    def unfolded(self, net: Network, df: DataFrame, k: int, made: list[int], last: bool = False) -> DataFrame:
        """df with a row for each key of a leaf's list that makes a tree with the nodes made, to which the leaf is added.

        last: no list is left. Compiled code keeps all rows that it makes of one row, so only one list may be unfolded in it; the
        others go through filter(), which Spark doesn't compile, and come row by row.
        """
        key, keys, earlier = f"t{k}_key", F.col(f"_keys{k}"), self.before(net)[k]
        others = [F.col(f"t{j}_key") for j in made if j not in earlier and self.distinct_rows(net, j, k)]
        lesser = [F.col(f"t{j}_key") for j in earlier[-1:]]
        if not last:
            keys = F.filter(keys, lambda x: reduce(Column.__and__, [*[c != x for c in others], *[c < x for c in lesser]], F.lit(True)))
            made.append(k)
            return df.withColumn(key, F.explode(keys)).drop(f"_keys{k}")
        for c in others:  # the list that can hold the other row's key loses it before it is unfolded, so that trees aren't tested one by one
            keys = F.when(c.between(F.element_at(f"_keys{k}", 1), F.element_at(f"_keys{k}", -1)), F.array_remove(keys, c)).otherwise(keys)
        made.append(k)
        return df.withColumn(key, F.explode(keys)).drop(f"_keys{k}").where(reduce(Column.__and__, [c < F.col(key) for c in lesser], F.lit(True)))

    def before(self, net: Network) -> dict[int, list[int]]:
        """For each node the leaves beside it that come before it where one order of equal subtrees counts; their keys are less than its own."""
        out: dict[int, list[int]] = {k: [] for k in range(net.size)}
        for a, b in net.twins() if self.break_symmetry else ():
            if len(b) == 1:
                out[b[0]] = [*out[a[0]], a[0]]
        return out

    def alike(self, net: Network, k: int, bunches: dict[int, tuple[str, list[int]]]) -> list[str]:
        """What rows of a leaf have in common in a class."""
        return [bunches[k][0], *(("tf", "dl") if net.nodes[k][1] else ())]

    def extremes(self, net: Network) -> DataFrame:
        """cn_key, n_trees, best, worst of all trees of a network, by counted(); no row if there are none."""
        df, score, _, _ = self.rated(net, self.counted(net))
        each = df.select(F.lit(net.key).alias("cn_key"), "n", score.alias("score"))
        return each.groupBy("cn_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_trees"), F.max("score").alias("best"), F.min("score").alias("worst"))

    def score(self, net: Network, held: list[int], tfs: list[Column], dl: Column) -> Column:
        s, p = self.stats, self.p
        tables = [net.nodes[k][0] for k in held]
        if p.method == "tuple_average":  # each row by its own table's statistics, averaged over the tree
            parts = []
            for k, t in zip(held, tables):
                norm = F.lit(0.8) + F.lit(0.2) * F.col(f"t{k}_dl") / F.lit(s.avgdl[t] or 1.0)
                for i, w in enumerate(s.keywords):
                    if s.df[t, w]:
                        parts.append(damped(F.col(f"t{k}_tf")[i]) / norm * F.lit(math.log(s.sizes[t] / s.df[t, w])))
            return reduce(Column.__add__, parts, F.lit(0.0)) / F.lit(float(net.size))
        if p.method == "virtual_document":  # the tree as one document, its best row damping the others
            total = F.lit(0.0)
            for i, w in enumerate(s.keywords):
                each = []
                for k, t in zip(held, tables):
                    norm = (F.lit(0.8) + F.lit(0.2) * F.col(f"t{k}_dl") / F.lit(s.avgdl[t] or 1.0)) * F.lit(1 + math.log(max(s.avgdl[t], 1.0)))
                    each.append(damped(F.col(f"t{k}_tf")[i]) * F.lit(s.idfs_plus_one[i]) / norm)
                top = F.greatest(*each) if len(each) > 1 else each[0]
                total = total + F.when(top > 0, top * damped(reduce(Column.__add__, each) / top)).otherwise(F.lit(0.0))
            return total * F.lit(1 / (0.8 + 0.2 * net.size / p.average_size))
        return tree_score(tfs, s.idfs, dl, sum(s.avgdl[t] for t in tables), self.weight(net), p, [max(s.max_tf[t, k] for t in s.sizes) for k in s.keywords])

    def top(self, net: Network, k: int, rows: DataFrame | None = None) -> DataFrame:
        return in_order(self.scored(net, self.rows(net, k=k) if rows is None else rows)).limit(k)

    def texts(self, top: DataFrame, net: Network) -> DataFrame:
        """top (of this network) with nodes array<struct<tbl, key, text>>: the few rows are joined back to the tables that have text."""
        df = top.withColumn("_keys", F.split("node_keys", r"\|"))
        nodes = []
        for k, (t, _) in enumerate(net.nodes):
            df = df.withColumn(f"_k{k}", F.expr(f"substring(element_at(_keys, {k + 1}), {len(t) + 2})"))
            text = self.db.spec.by_name[t].text
            if text:
                own = self.db[t].select(identity(self.db, t).alias(f"_k{k}"), row_text(text).alias(f"_x{k}"))
                df = own.join(F.broadcast(df), f"_k{k}")  # k rows at most
            else:
                df = df.withColumn(f"_x{k}", F.lit(None).cast("string"))
            nodes.append(F.struct(F.lit(t).alias("tbl"), F.col(f"_k{k}").alias("key"), F.col(f"_x{k}").alias("text")))
        return df.select("score", "cn_size", "cn_key", "node_keys", "dl", "tf", F.array(*nodes).alias("nodes"))


def in_order(df: DataFrame) -> DataFrame:
    """A total order, so that results don't depend on the plan."""
    return df.orderBy(F.desc("score"), "cn_size", "cn_key", "node_keys")


def damped(t: Column) -> Column:
    """1 + ln(1 + ln t) from 1 on, t itself below."""
    return F.when(t >= 1, 1 + F.log(1 + F.log(F.greatest(t, F.lit(1.0)).cast("double")))).otherwise(F.greatest(t, F.lit(0.0)).cast("double"))
