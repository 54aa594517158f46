"""Candidate networks: trees over foreign keys whose leaves all hold keywords. Planning only, in plain Python."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from ..spec import SchemaSpec


@dataclass(frozen=True)
class Edge:
    """Node fk refers to node parent_key by foreign key number key of the schema."""

    fk: int
    pk: int
    key: int


@dataclass(frozen=True)
class Network:
    """nodes: (table, holds keywords). Node numbers follow the canonical order once made()."""

    nodes: tuple[tuple[str, bool], ...]
    edges: tuple[Edge, ...] = ()

    @property
    def size(self) -> int:
        return len(self.nodes)

    @property
    def nonfree(self) -> int:
        return sum(nf for _, nf in self.nodes)

    @cached_property
    def around(self) -> list[list[tuple[int, str]]]:
        """For each node its neighbours, with the label of the way there."""
        out: list[list[tuple[int, str]]] = [[] for _ in self.nodes]
        for e in self.edges:
            out[e.fk].append((e.pk, f">{e.key}"))
            out[e.pk].append((e.fk, f"<{e.key}"))
        return out

    def name(self, node: int, up: int = -1) -> str:
        """The subtree of node, children in order: equal for equal subtrees only."""
        table, nf = self.nodes[node]
        below = sorted(label + self.name(n, node) for n, label in self.around[node] if n != up)
        return f"{table}{'*' if nf else ''}" + (f"({','.join(below)})" if below else "")

    def centres(self) -> list[int]:
        left, degree = set(range(self.size)), {k: len(a) for k, a in enumerate(self.around)}
        while len(left) > 2:
            leaves = [k for k in left if degree[k] <= 1]
            for k in leaves:
                left.remove(k)
                for n, _ in self.around[k]:
                    degree[n] -= 1
        return sorted(left)

    @cached_property
    def root(self) -> int:
        return min(self.centres(), key=self.name)

    @cached_property
    def key(self) -> str:
        return self.name(self.root)

    def leaves(self) -> list[int]:
        return [k for k, a in enumerate(self.around) if len(a) <= 1]

    def order(self) -> list[int]:
        """Nodes depth first from the centre in canonical order; equal networks correspond place by place."""
        order: list[int] = []

        def visit(node: int, up: int) -> None:
            order.append(node)
            for _, n in sorted((label + self.name(n, node), n) for n, label in self.around[node] if n != up):
                visit(n, node)

        visit(self.root, -1)
        return order

    def made(self) -> Network:
        """The same tree, nodes numbered in canonical order."""
        order = self.order()
        at = {old: new for new, old in enumerate(order)}
        edges = sorted((Edge(at[e.fk], at[e.pk], e.key) for e in self.edges), key=lambda e: (max(e.fk, e.pk), e.key))
        return Network(tuple(self.nodes[k] for k in order), tuple(edges))

    def side(self, edge: Edge, node: int) -> tuple[Network, list[int]]:
        """What hangs together with node once edge is cut, as a network made(), and the nodes of this network that its nodes are."""
        found, todo = [node], [node]
        while todo:
            k = todo.pop()
            for e in self.edges:
                if e != edge and k in (e.fk, e.pk) and (n := e.fk + e.pk - k) not in found:
                    found.append(n)
                    todo.append(n)
        found.sort()
        at = {old: new for new, old in enumerate(found)}
        half = Network(tuple(self.nodes[k] for k in found), tuple(Edge(at[e.fk], at[e.pk], e.key) for e in self.edges if e.fk in at and e.pk in at))
        return half.made(), [found[k] for k in half.order()]

    def twins(self) -> list[tuple[list[int], list[int]]]:
        """Pairs of equal subtrees beside each other, as nodes in order: one of the two orders is enough. For made() networks."""
        found: list[tuple[list[int], list[int]]] = []

        def below(node: int, up: int) -> list[int]:
            return [node, *(x for n in self.children(node, up) for x in below(n, node))]

        def visit(node: int, up: int) -> None:
            kids = self.children(node, up)
            labels = dict(self.around[node])
            for a, b in zip(kids, kids[1:]):
                if labels[a] + self.name(a, node) == labels[b] + self.name(b, node):
                    found.append((below(a, node), below(b, node)))
            for k in kids:
                visit(k, node)

        visit(0, -1)
        return found

    def children(self, node: int, up: int) -> list[int]:
        return sorted(n for n, _ in self.around[node] if n != up)

    def cuts(self) -> list[tuple[str, str, Edge]]:
        """For each edge the canonical names of both halves: networks that share a half share its join."""
        return [(self.name(e.fk, e.pk), self.name(e.pk, e.fk), e) for e in self.edges]


def generate(spec: SchemaSpec, nonfree: Iterable[str], max_size: int = 4, stars: Iterable[str] = ()) -> list[Network]:
    """All networks of max_size nodes at most: leaves hold keywords (or are of a star table), no row refers twice by one foreign key; each once, by size and name."""
    nf, star = set(nonfree), set(stars)
    level = {n.key: n for n in (Network(((t, True),)) for t in sorted(nf))}
    kept = list(level.values())
    for _ in range(max_size - 1):
        grown: dict[str, Network] = {}
        for net in level.values():
            used = {(e.fk, e.key) for e in net.edges}
            new = len(net.nodes)
            for at, (table, _) in enumerate(net.nodes):
                for k, f in enumerate(spec.fks):
                    steps = []
                    if f.fk_table == table and (at, k) not in used:
                        steps.append((f.pk_table, Edge(at, new, k)))
                    if f.pk_table == table:
                        steps.append((f.fk_table, Edge(new, at, k)))
                    for other, edge in steps:
                        for holds in (False, True) if other in nf else (False,):
                            tree = Network((*net.nodes, (other, holds)), (*net.edges, edge))
                            grown.setdefault(tree.key, tree)
        level = grown
        kept += [n for n in grown.values() if all(n.nodes[k][1] or n.nodes[k][0] in star for k in n.leaves())]
    return sorted((n.made() for n in kept), key=lambda n: (n.size, n.key))


class NetworkIndex:
    """Networks of each set of keyword tables, made when first asked for."""

    def __init__(self, spec: SchemaSpec, max_size: int = 4):
        self.spec, self.max_size = spec, max_size
        self.found: dict[tuple[frozenset[str], frozenset[str]], list[Network]] = {}

    def of(self, nonfree: Iterable[str], stars: Iterable[str] = ()) -> list[Network]:
        key = (frozenset(nonfree), frozenset(stars))
        if key not in self.found:
            self.found[key] = generate(self.spec, key[0], self.max_size, key[1])
        return self.found[key]

    def fill(self) -> NetworkIndex:
        """Every set of text tables."""
        from itertools import combinations

        tables = self.spec.text_tables
        for n in range(1, len(tables) + 1):
            for s in combinations(tables, n):
                self.of(s)
        return self
