"""URL filters: longest-prefix rules, and a Bloom filter cascade for a list of hosts.

The cascade holds a list exactly over a known universe of keys. Level 0 encodes the listed keys; every later level
encodes those keys of the other side that pass all levels before by mistake: unlisted keys that pass level 0, then
listed keys that pass level 1, and so on until none is left. A key's first failing level tells its side, so membership
is exact for every key of the universe and takes no join. The universe is the corpus's: each host with its parent
domains. Level 0 has as many bits a key as let about as many unlisted keys pass as are listed, so what the later levels
hold doesn't grow with the corpus: the size is of the order of |list| log(|universe| / |list|). Only keys that pass
level 0 are told apart by a join with the list; the universe itself isn't shuffled. Levels are built by Spark (bits set
per task, joined by bitwise or). Sizes are known before anything is broadcast: where they would pass max_bytes, judge()
gives the same verdicts by an equi-join, dealt by salts.

A rule is 'host/path' with a verdict; it fits its host and all subdomains if the path starts with the rule's, and the
longest (then the last of its own order, which is by text) wins.

Null urls and urls without '://' have an empty host and an empty path, fit no rule and are allowed: the empty host is never listed.
Hosts of rules and lists are lower-cased (A-Z), as those of urls are; null and empty hosts in a list count as none, repeated
ones as one. Repeated rows stay; null ids stay null. An empty list or an empty table allows all that no rule blocks. Long
urls are read whole; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, store

#: Chance of a later level to let a key of the other side pass.
LATER = 1 / 16
#: Most bytes of a cascade that is broadcast, and parts that a host's rows are dealt to in the join beyond it.
MAX_BYTES, SALTS = 32 << 20, 32


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def parse_rules(lines: list[str]) -> list[Rule]:
    """'allow net/docs/' -> Rule('allow', 'net', '/docs/')."""
    found = []
    for line in lines:
        verdict, _, rule = line.strip().partition(" ")
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {line!r}")
        found.append(Rule(verdict, host.translate(LOWER), slash + path))
    return found


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lowered(raw), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; for lists of some hundred rules."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), r.text))
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(pick)
    return pick


def domains_of(host: Column) -> Column:
    """A host and its parent domains: a.b.c -> [a.b.c, b.c, c]; of the empty host none."""
    labels = F.split(host, r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.filter(each, lambda d: d != "")


@dataclass
class Cascade:
    """levels: bit arrays and their numbers of probes; level k's hashes are seeded by k."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        """keys: 64-bit hashes of two columns. The first failing level k tells: even: unlisted, odd: listed."""
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.arange(len(keys))
        for k, (bits, probes) in enumerate(self.levels):
            passed = probe(bits, probes, keys[open_], k)
            out[open_[~passed]] = k % 2 == 1
            open_ = open_[passed]
        return out


def slots(keys: np.ndarray, level: int, n_bits: int, probes: int) -> np.ndarray:
    """Slots for each key, by double hashing; keys: n x 2 of uint64."""
    with np.errstate(over="ignore"):
        a = keys[:, 0] * np.uint64(2 * level + 1) + (keys[:, 1] >> np.uint64(level % 32))
        b = (keys[:, 1] * np.uint64(2 * level + 3)) | np.uint64(1)
        a ^= a >> np.uint64(31)
        return (a[:, None] + np.arange(probes, dtype=np.uint64) * b[:, None]) % np.uint64(n_bits)


def probe(bits: np.ndarray, probes: int, keys: np.ndarray, level: int) -> np.ndarray:
    at = slots(keys, level, len(bits) * 8, probes)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1) if len(at) else np.zeros(0, dtype=bool)


def hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h0"), F.xxhash64(F.lit("second"), F.col(key)).alias("h1")]


def keys_of(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(i).to_numpy().view(np.uint64) for i in (0, 1)], axis=1)


def size_of(n: int, chance: float) -> tuple[int, int]:
    """Bytes and probes of a level of n keys that lets others pass by that chance."""
    return max(64, math.ceil(n * math.log2(1 / chance) / math.log(2) / 8 / 64) * 64), max(1, round(math.log2(1 / chance)))


def first_chance(n_listed: int, n_universe: int) -> float:
    return min(LATER, max(n_listed, 1) / max(n_universe, 1))


def estimated_bytes(n_listed: int, n_universe: int) -> int:
    """Of all levels: the first, and the later ones of about so many keys as are listed, fewer from level to level."""
    return size_of(n_listed, first_chance(n_listed, n_universe))[0] + 4 * size_of(n_listed, LATER)[0]


def filter_of(keys: DataFrame, n_bytes: int, probes: int, level: int) -> np.ndarray:
    """The bits of a level over keys (h0, h1): each task sets its own, equal words are joined by bit_or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n_bytes, dtype=np.uint8)
        for b in batches:
            at = slots(keys_of(b), level, n_bytes * 8, probes).ravel()
            np.bitwise_or.at(own, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        words = own.view("<i8")
        at = np.flatnonzero(words)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    t = keys.select("h0", "h1").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(n_bytes, dtype=np.uint8)
    out.view("<i8")[t["at"].to_numpy()] = t["word"].to_numpy()
    return out


def build(universe: DataFrame, listed: DataFrame, key: str, n_universe: int | None = None, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """universe, listed: one column key; keys of the universe may repeat. Exact over the universe's keys; listed keys outside it don't matter. None if the levels would pass max_bytes."""
    keys = listed.select(key).where(F.col(key).isNotNull()).distinct().select(key, *hashes(key))
    inside = store(keys, "listed")
    n = inside.count()
    if n_universe is None:
        n_universe = universe.agg(F.approx_count_distinct(key)).first()[0]
    if estimated_bytes(n, n_universe) > max_bytes:
        discard(inside)
        return None
    out, made, spark = Cascade(), [inside], universe.sparkSession
    now, other = inside, universe.select(key).where(F.col(key).isNotNull()).select(key, *hashes(key))
    while n:
        level = len(out.levels)
        if level >= 64:
            raise ValueError("two keys of different sides have equal hashes")
        n_bytes, probes = size_of(n, LATER if level else first_chance(n, n_universe))
        if sum(len(b) for b, _ in out.levels) + n_bytes > max_bytes:
            discard(*made)
            return None
        bits = filter_of(now, n_bytes, probes, level)
        out.levels.append((bits, probes))
        shared = spark.sparkContext.broadcast((bits, probes))  # max_bytes at most

        def passing(batches: Iterator[pa.RecordBatch], level: int = level, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = np.stack([b.column(i).to_numpy().view(np.uint64) for i in (1, 2)], axis=1)
                yield b.filter(pa.array(probe(*shared.value, keys, level)))

        wrong = other.mapInArrow(passing, other.schema)
        if not level:  # of the universe's keys only those that pass are told apart and counted once
            wrong = wrong.join(inside.select(key), key, "left_anti").distinct()
        wrong = store(wrong, "level")
        made.append(wrong)
        now, other, n = wrong, now, wrong.count()
    discard(*made)
    return out


def blocked_column(df: DataFrame, cascade: Cascade, domains: str, out: str) -> DataFrame:
    """df with boolean column out: any of the domains (array<string>) is listed."""
    shared = df.sparkSession.sparkContext.broadcast(cascade.levels)  # build() bounds it
    names = [c for c in df.columns if c != domains]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cascade(shared.value)
        for b in batches:
            flat = [b.column(i).flatten().to_numpy().view(np.uint64) for i in (0, 1)]
            hit = own.listed(np.stack(flat, axis=1))
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column(0).offsets.to_numpy()))
            blocked = np.zeros(b.num_rows, dtype=bool)
            blocked[of[hit]] = True
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(blocked)], names=[*names, out])

    h0 = F.transform(domains, lambda d: F.xxhash64(d))
    h1 = F.transform(domains, lambda d: F.xxhash64(F.lit("second"), d))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(h0.alias("_h0"), h1.alias("_h1"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, `{out}` boolean")


def blocked_by_join(df: DataFrame, listed: DataFrame, domains: str, out: str) -> DataFrame:
    """The same by an equi-join, for lists of any size. Hosts are told once each; rows meet their host's answer by host and salt, so a hot host is dealt to SALTS tasks."""
    hosts = df.select("host", domains).distinct()
    hit = hosts.select("host", F.explode(domains).alias("domain")).join(listed.select(F.col(listed.columns[0]).alias("domain")).distinct(), "domain", "left_semi")
    salted = hit.select("host").distinct().select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias(out))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", domains, "rule", "_verdict")], "path"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["host", "_salt"], "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_salt", domains)


def judge(df: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """id, host, path, rule, verdict of every row. listed: one column host; a url without a fitting rule is blocked if its host or a parent domain is listed."""
    url = F.col(f"`{url_col}`").cast("string")
    parts = df.select(F.col(f"`{id_col}`").alias("_key"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select("_key", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"), domains_of(F.col("host")).alias("_domains"))
    hosts = listed.select(lowered(F.col(f"`{listed.columns[0]}`")).alias("host")).where("host <> ''")
    universe = df.select(F.explode(domains_of(host_of(url))).alias("host"))
    cascade = build(universe, hosts, "host", max_bytes=max_bytes)
    found = blocked_column(ruled, cascade, "_domains", "_blocked") if cascade else blocked_by_join(ruled, hosts, "_domains", "_blocked")
    verdict = F.coalesce("_verdict", F.when(F.col("_blocked"), "block").otherwise("allow"))
    return found.select(F.col("_key").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
