"""The searches as DuckDB SQL over the same tables, to compare with.

Keywords, networks, their joins and their weights are written out here by hand; nothing is taken from the parser, the generator or the formulas
that they check. The labels of networks are those that the engine prints.
"""

from __future__ import annotations

from dataclasses import dataclass

from .functions.score import Params
from .spec import SALES, SchemaSpec


@dataclass(frozen=True)
class Word:
    words: tuple[str, ...]
    must: bool = False
    table: str | None = None

    @property
    def phrase(self) -> bool:
        return len(self.words) > 1


@dataclass(frozen=True)
class Asked:
    ranked: tuple[Word, ...]
    excluded: tuple[Word, ...] = ()


def asked(*words: str | Word, without: str = "") -> Asked:
    return Asked(tuple(w if isinstance(w, Word) else Word((w,)) for w in words), (Word((without,)),) if without else ())


@dataclass(frozen=True)
class Tree:
    """nodes: tables, those with keywords marked *; joins: 'node.column=node.column'; twins: pairs of lists of nodes of which one order counts."""

    key: str
    nodes: str
    joins: str = ""
    twins: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...] = ()

    @property
    def tables(self) -> list[tuple[str, bool]]:
        return [(n.rstrip("*"), n.endswith("*")) for n in self.nodes.split()]

    @property
    def size(self) -> int:
        return len(self.tables)

    @property
    def held(self) -> list[int]:
        return [k for k, (_, h) in enumerate(self.tables) if h]


TWO, THREE = (((1,), (2,)),), (((1,), (2,)), ((2,), (3,)))
CUSTOMER, PART, SUPPLIER, REGION = (Tree(f"{t}*", f"{t}*") for t in ("customer", "part", "supplier", "region"))
CUSTOMERS_2 = Tree("nation(<1customer*,<1customer*)", "nation customer* customer*", "1.c_nationkey=0.n_nationkey 2.c_nationkey=0.n_nationkey", TWO)
CUSTOMERS_3 = Tree("nation(<1customer*,<1customer*,<1customer*)", "nation customer* customer* customer*", "1.c_nationkey=0.n_nationkey 2.c_nationkey=0.n_nationkey 3.c_nationkey=0.n_nationkey", THREE)
ORDERED = Tree("lineitem(>4orders(>3customer*),>5part*)", "lineitem orders customer* part*", "0.l_orderkey=1.o_orderkey 1.o_custkey=2.c_custkey 0.l_partkey=3.p_partkey")
ORDERED_FREE = Tree("lineitem(>4orders(>3customer*),>5part)", "lineitem orders customer* part", "0.l_orderkey=1.o_orderkey 1.o_custkey=2.c_custkey 0.l_partkey=3.p_partkey")
SUPPLIED = Tree("lineitem(>5part*,>6supplier*)", "lineitem part* supplier*", "0.l_partkey=1.p_partkey 0.l_suppkey=2.s_suppkey")
SUPPLIERS_2 = Tree("nation(<2supplier*,<2supplier*)", "nation supplier* supplier*", "1.s_nationkey=0.n_nationkey 2.s_nationkey=0.n_nationkey", TWO)
SUPPLIERS_3 = Tree("nation(<2supplier*,<2supplier*,<2supplier*)", "nation supplier* supplier* supplier*", "1.s_nationkey=0.n_nationkey 2.s_nationkey=0.n_nationkey 3.s_nationkey=0.n_nationkey", THREE)
NEIGHBOURS = Tree("nation(<1customer*,<2supplier*)", "nation customer* supplier*", "1.c_nationkey=0.n_nationkey 2.s_nationkey=0.n_nationkey")
DELIVERED = Tree("lineitem(>4orders(>3customer*),>6supplier*)", "lineitem orders customer* supplier*", "0.l_orderkey=1.o_orderkey 1.o_custkey=2.c_custkey 0.l_suppkey=3.s_suppkey")
_PAIR = "1.{0}=0.{1} 1.l_partkey=2.p_partkey 3.{0}=0.{1} 3.l_partkey=4.p_partkey"
ORDER_PARTS = Tree("orders(<4lineitem(>5part*),<4lineitem(>5part*))", "orders lineitem part* lineitem part*", _PAIR.format("l_orderkey", "o_orderkey"), (((1, 2), (3, 4)),))
SUPPLIER_PARTS = Tree("supplier(<6lineitem(>5part*),<6lineitem(>5part*))", "supplier lineitem part* lineitem part*", _PAIR.format("l_suppkey", "s_suppkey"), (((1, 2), (3, 4)),))
REGION_PART = Tree("supplier(<6lineitem(>5part*),>2nation(>0region*))", "supplier lineitem part* nation region*", "1.l_suppkey=0.s_suppkey 1.l_partkey=2.p_partkey 0.s_nationkey=3.n_nationkey 3.n_regionkey=4.r_regionkey")

#: Networks by the tables that hold keywords, of at most 4 nodes; of at most 5 where said.
CUSTOMER_PART = [CUSTOMER, PART, CUSTOMERS_2, ORDERED, CUSTOMERS_3]
PART_SUPPLIER = [PART, SUPPLIER, SUPPLIED, SUPPLIERS_2, SUPPLIERS_3]
REGION_PART_5 = [PART, REGION, ORDER_PARTS, SUPPLIER_PARTS, REGION_PART]
#: For words that one customer and one supplier hold: those with two of either are empty.
ONE_CUSTOMER_SUPPLIER = [CUSTOMER, SUPPLIER, NEIGHBOURS, DELIVERED]


def weight(size: int, held: int, n: int) -> str:
    return f"((1.15::DOUBLE - 0.15::DOUBLE * {size}) * (1 + 1::DOUBLE / {n + 1} - {held}::DOUBLE / {n + 1}))"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[[:punct:][:space:]]+'), lambda w: NOT regexp_matches(w, '^[A-Za-z0-9]?$'))"


def words_of(spec: SchemaSpec, table: str) -> str:
    return tok(f"concat_ws(' ', {', '.join(spec.by_name[table].text)})")


def key_of(spec: SchemaSpec, table: str) -> str:
    return f"concat_ws('-', {', '.join(spec.by_name[table].identity)})"


def count_sql(k: Word, spec: SchemaSpec, table: str, words: str = "w") -> str:
    if k.table is not None and k.table != table:
        return "0"
    if k.phrase:
        return "(" + " OR ".join(f"contains(' ' || array_to_string({tok(c)}, ' ') || ' ', ' {' '.join(k.words)} ')" for c in spec.by_name[table].text) + ")::INT"
    return f"len(list_filter({words}, lambda x: x = '{k.words[0]}'))::INT"


def damp(t: str) -> str:
    return f"(CASE WHEN {t} > 0 THEN 1 + ln(1 + ln(greatest({t}, 1))) ELSE 0.0 END)"


def soft(t: str) -> str:
    return f"(CASE WHEN {t} >= 1 THEN 1 + ln(1 + ln(greatest({t}, 1.0))) ELSE greatest({t}, 0.0) END)"


def base_ctes(q: Asked, spec: SchemaSpec = SALES) -> list[str]:
    """c_<table>: counts of every row; st: one row of statistics; nf_<table>: keyword rows; fr_<table>: free rows."""
    n = len(q.ranked)
    out, stats = [], []
    for t in spec.text_tables:
        counts = ", ".join(f"{count_sql(k, spec, t)} AS c{i}" for i, k in enumerate(q.ranked))
        bad = " + ".join(count_sql(k, spec, t) for k in q.excluded) or "0"
        out.append(f"c_{t} AS (SELECT *, {key_of(spec, t)} AS key, len(w)::INT AS dl, {counts}, {bad} AS bad FROM (SELECT *, {words_of(spec, t)} AS w FROM {t}))")
        aggs = ", ".join(f"count(*) FILTER (c{i} > 0) AS df_{t}_{i}" for i in range(n))
        stats.append(f"(SELECT count(*) AS n_{t}, avg(dl) AS avgdl_{t}, count(*) FILTER ({' OR '.join(f'c{i} > 0' for i in range(n))}) AS nnf_{t}, {aggs} FROM c_{t})")
    total = " + ".join(f"n_{t}" for t in spec.text_tables)
    sums = [" + ".join(f"df_{t}_{i}" for t in spec.text_tables) for i in range(n)]
    idfs = ", ".join(f"({s}) AS df{i}, ln(greatest(({total}) - ({s}), 0.5) / ({s})) + {i} * 1e-13 AS idf{i}, ln(({total}) / (({s}) + 1)) AS idfp{i}" for i, s in enumerate(sums))
    out.append(f"st AS (SELECT *, ({total}) AS n, {idfs} FROM {', '.join(stats)})")
    for t in spec.text_tables:
        local = " + ".join(["0.0", *[f"{damp(f'c{i}')} * idf{i}" for i in range(n)]])
        out.append(f"nf_{t} AS (SELECT c.*, {local} AS score FROM c_{t} c, st WHERE ({' OR '.join(f'c{i} > 0' for i in range(n))}) AND bad = 0)")
    for t in (x.name for x in spec.tables):
        out.append(f"fr_{t} AS (SELECT * FROM c_{t} WHERE bad = 0)" if spec.by_name[t].text else f"fr_{t} AS (SELECT *, {key_of(spec, t)} AS key FROM {t})")
    return out


def network_sql(net: Tree, q: Asked, p: Params = Params(), spec: SchemaSpec = SALES, break_symmetry: bool = True, and_mode: str = "filter") -> str:
    n, held, nodes = len(q.ranked), net.held, net.tables
    where = [" = ".join(f"t{x}" for x in j.split("=")) for j in net.joins.split()]
    for b, (t, _) in enumerate(nodes):
        where += [f"t{a}.key <> t{b}.key" for a in range(b) if nodes[a][0] == t and t != "lineitem"]
    for a, b in net.twins if break_symmetry else ():
        where.append(f"({', '.join(f't{k}.key' for k in a)}) < ({', '.join(f't{k}.key' for k in b)})" if len(a) > 1 else f"t{a[0]}.key < t{b[0]}.key")
    tfs = ["(" + " + ".join(f"t{k}.c{i}" for k in held) + ")" for i in range(n)]
    where += [f"{tfs[i]} > 0" for i, k in enumerate(q.ranked) if k.must and and_mode == "filter"]
    dl = "(" + " + ".join(f"t{k}.dl" for k in held) + ")"
    tables = [nodes[k][0] for k in held]
    if p.method == "tuple_average":
        parts = [f"CASE WHEN df_{t}_{i} > 0 THEN {soft(f't{k}.c{i}')} / (0.8 + 0.2 * t{k}.dl / avgdl_{t}) * ln(n_{t}::DOUBLE / df_{t}_{i}) ELSE 0.0 END" for k, t in zip(held, tables) for i in range(n)]
        score = f"({' + '.join(['0.0', *parts])}) / {net.size}"
    elif p.method == "virtual_document":
        each = [[f"{soft(f't{k}.c{i}')} * idfp{i} / ((0.8 + 0.2 * t{k}.dl / avgdl_{t}) * (1 + ln(greatest(avgdl_{t}, 1.0))))" for k, t in zip(held, tables)] for i in range(n)]
        parts = []
        for x in each:
            top = f"greatest({', '.join(x)})"
            parts.append(f"CASE WHEN {top} > 0 THEN {top} * {soft(f'(({" + ".join(x)}) / {top})')} ELSE 0.0 END")
        score = f"({' + '.join(['0.0', *parts])}) * (1 / (0.8 + 0.2 * {net.size} / {p.average_size}))"
    else:
        local = " + ".join(["0.0", *[f"{damp(tf)} * idf{i}" for i, tf in enumerate(tfs)]])
        missing = " + ".join(f"({tf} = 0)::INT" for tf in tfs)
        lost = f"pow({missing}, {1 / p.alpha!r})"
        if p.soft_missing:
            top = [f"greatest({', '.join(f'(SELECT max(c{i}) FROM c_{t})' for t in spec.text_tables)})" for i in range(n)]
            largest = f"greatest({', '.join(f'idf{i}' for i in range(n))})"
            lacks = " + ".join(f"pow(least(greatest(1.0 - {tfs[i]} * (idf{i} / {largest} / {top[i]}), 0.0), 1.0), {p.alpha!r})" for i in range(n))
            lost = f"pow({lacks}, {1 / p.alpha!r})"
        avdl = " + ".join(f"avgdl_{t}" for t in tables)
        score = f"({local}) * {weight(net.size, len(held), n)} * (pow({n}, {1 / p.alpha!r}) - {lost}) * ({1 - p.s!r} / ({1 - p.s!r} + {p.s!r} * {dl} / ({avdl})))"
    keys = " || '|' || ".join(f"'{t}:' || t{k}.key" for k, (t, _) in enumerate(nodes))
    source = ", ".join(f"{'nf' if h else 'fr'}_{t} t{k}" for k, (t, h) in enumerate(nodes))
    return f"SELECT round({score}, 9) AS score, {net.size}::INT AS cn_size, '{net.key}' AS cn_key, {keys} AS node_keys, {dl}::INT AS dl, [{', '.join(tfs)}] AS tf FROM {source}, st" + (f" WHERE {' AND '.join(where)}" if where else "")


def networks_sql(q: Asked, networks: list[Tree], p: Params = Params(), select: str = "*", tail: str = "", **how) -> str:
    parts = " UNION ALL ".join(f"({network_sql(n, q, p, **how)})" for n in networks)
    return f"WITH {', '.join(base_ctes(q))}, trees AS ({parts}) SELECT {select} FROM trees {tail}"


def top_sql(q: Asked, networks: list[Tree], k: int = 10, p: Params = Params(), **how) -> str:
    return networks_sql(q, networks, p, tail=f"ORDER BY score DESC, cn_size, cn_key, node_keys LIMIT {k}", **how)
