"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints of 64 bits link at `most` or fewer differing bits (4 unless another number is asked for). So many bits
touch as many of the eight bytes at most, so linked fingerprints share at least 8 - most positional bytes. A posting list
for a single byte would hold 1/256 of the corpus, so the index is keyed by groups of positional bytes, such that one group is
within every choice of 8 - most positions (Turan's construction; 20 triples for 4 bits, 12 pairs for 5), and no link
is lost. Within a list the shared positional bytes of each pair are tallied, pairs under the minimum are dropped, the
rest is verified by counting differing bits, and what leaves the list is a forest of links, never all pairs: classes,
not pairs, are asked for.

A list of over LIMIT fingerprints isn't compared but split further by the same rule over the units that its key leaves
free: bytes, then half bytes, pairs of bits, bits, as long as links must share two of them. At the last step a list has
4096 fingerprints at most; every step keeps all links, and no list is capped.

Equal fingerprints are one node (grouped with map-side minima); links join nodes; see components.py.

`verify` asks for a second fingerprint of five-word shingles beside the first: links then also need so few differing
bits of that one. It serves one_of_each(), whose first fingerprint is made of single words: 64 bits of shingles differ
in about 10 at a similarity of 0.8, single words in 5 at most as a rule, but texts of one language come near each other by chance.

Null and blank texts have fingerprint zero and link like any other. Null ids take part but never name a class unless
it has no other id. Ids may be of any ordered type. Repeated rows give repeated rows. An empty table gives no rows.
Long texts are read whole. Other columns, whatever their names, are left out (one_of_each keeps them).
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import beside, discard, map_batches, store, text_or_empty, type_of
from .components import components

WORDS, SEED, MOST = 4, 42, 4
#: For one_of_each: most differing bits of the fingerprint of words, and of that of shingles; words of a shingle.
NEAR, VERIFY, SHINGLE = 5, 14, 5
#: A posting list with more fingerprints than this is split further.
LIMIT = 2048
#: Most hot keys that are broadcast (16 bytes each); with more, the join is left to the optimizer.
HOT_KEYS = 100_000
#: With fewer bits free a list isn't split again.
LEAST_FREE = 12


def triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions, one of them within every four positions."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for g in groups for t in combinations(g, 3)]
    for k, g in enumerate(groups):
        found += [(*pair, other) for pair in combinations(g, 2) for other in groups[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


def covering(n: int, shared: int) -> list[tuple[int, ...]]:
    """Groups of n positions, one of them within every choice of shared positions."""
    if shared == 1:
        return [(k,) for k in range(n)]
    if (n, shared) == (8, 4):
        return triples()
    return [pair for g in range(shared - 1) for pair in combinations(range(g, n, shared - 1), 2)]


@lru_cache(maxsize=1 << 12)
def children(mask: int, most: int = MOST) -> tuple[int, ...]:
    """Masks to split a list of this mask by; none if it isn't split."""
    if 64 - mask.bit_count() <= LEAST_FREE:
        return ()
    for wide in (8, 4, 2, 1):
        free = [u for k in range(0, 64, wide) if not (u := ((1 << wide) - 1) << k) & mask]
        if len(free) - most >= (1 if not mask else 2):
            return tuple(mask | sum(free[k] for k in group) for group in covering(len(free), len(free) - most))
    return ()


def print_of(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bit i is set if it is in over half the hashes, by weight."""
    n, total = len(hashes), len(hashes) if weights is None else weights.sum()
    ones = np.zeros(64, dtype=np.int64 if weights is None else np.float64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[k : k + (1 << 14)] @ bits
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the shingles of size words, repeats included; of fewer words the whole sequence is the only one."""
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    starts, ends = at[:n].tolist(), (at[size:] - 1).tolist() if len(words) >= size else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), dtype="<u8", count=n)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks only


def fingerprint(text: str) -> int:
    words = words_of(text)
    return print_of(shingles(words, WORDS)) if words else 0


def word_prints(text: str) -> tuple[int, int]:
    """Fingerprint of the words, weighed by their lengths and a power of their counts so that common short ones don't decide, and that of the shingles of SHINGLE words."""
    words = words_of(text)
    if not words:
        return 0, 0
    counts = Counter(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), dtype="<u8", count=len(counts))
    n, size = (np.fromiter(x, dtype=np.float64, count=len(counts)) for x in (counts.values(), map(len, counts)))
    return print_of(hashes, n**0.7 * size), print_of(shingles(words, SHINGLE))


def signed(prints: list[int]) -> pa.Array:
    return pa.array(np.array(prints, dtype=np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp long (the 64 bits, signed), for every row of df."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), signed([fingerprint(t) for t in b.column(1).to_pylist()])], names=[id_col, "fp"])

    return map_batches(df.select(F.col(f"`{id_col}`"), text_or_empty(text_col).alias("text")), run, f"`{id_col}` {type_of(df, id_col)}, fp long")


def keyed(rows: DataFrame, most: int) -> DataFrame:
    """fp, also, and mask if rows are of a list that is split: gives mask, fp, also for each list of the next step that fp is in."""
    split = "mask" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, also = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("fp", "also"))
            of = b.column(b.schema.get_field_index("mask")).to_numpy() if split else np.zeros(len(fp), dtype=np.int64)
            for m in np.unique(of):
                own = of == m
                nexts = np.array(children(int(np.int64(m).view(np.uint64)), most), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nexts, own.sum())), pa.array(np.tile(fp[own], len(nexts))), pa.array(np.tile(also[own], len(nexts)))], names=["mask", "fp", "also"])

    return rows.mapInArrow(run, "mask long, fp long, also long")


def links_of(fp: np.ndarray, also: np.ndarray, group: np.ndarray, most: int, verify: int) -> np.ndarray:
    """Links within groups (equal values stand together), as two rows of places: a forest's or a few more. All groups are compared at once, neighbour by neighbour."""
    root = np.arange(len(fp))
    at, lag, found = root.copy(), 1, []
    while True:
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + lag]
        near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most  # the tally of shared positional bytes
        near[near] = np.bitwise_count(x[near]) <= most  # verified
        if verify < 64:
            near[near] = np.bitwise_count(also[at[near]] ^ also[at[near] + lag]) <= verify
        a = at[near]
        ra, rb = root[a], root[a + lag]
        new = ra != rb
        if new.any():
            found.append(np.stack([a[new], a[new] + lag]))
            np.minimum.at(root, np.maximum(ra, rb)[new], np.minimum(ra, rb)[new])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        lag += 1
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)


def node_name(fp: np.ndarray, also: np.ndarray, verify: int) -> np.ndarray:
    """One number for a node: the fingerprint, or where there are two a mix of both."""
    if verify >= 64:
        return fp.view(np.int64)
    with np.errstate(over="ignore"):
        x = (fp ^ (also * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def compare(rows: DataFrame, most: int, verify: int) -> DataFrame:
    """rows: mask, fp, also, no list over LIMIT. Gives links a, b."""
    value = F.col("fp").bitwiseAND(F.col("mask"))
    sorted_rows = rows.select("mask", value.alias("value"), "fp", "also").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp", "also")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((4, 0), dtype=np.int64)

        def out(part: np.ndarray) -> pa.RecordBatch:
            part = part[:, np.r_[True, (np.diff(part) != 0).any(axis=0)]]  # a fingerprint comes twice if two split lists give it
            group = np.cumsum(np.r_[0, (np.diff(part[:2]) != 0).any(axis=0)])
            fp, also = np.ascontiguousarray(part[2]).view(np.uint64), np.ascontiguousarray(part[3]).view(np.uint64)
            a, b = links_of(fp, also, group, most, verify)
            name = node_name(fp, also, verify)
            return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if rest.shape[1] >= 1 << 16:
                whole = int(np.flatnonzero((rest[:2] != rest[:2, -1:]).any(axis=0)).max(initial=-1)) + 1  # the last list may go on
                if whole:
                    yield out(rest[:, :whole])
                    rest = rest[:, whole:]
        if rest.shape[1]:
            yield out(rest)

    return sorted_rows.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, limit: int = LIMIT, most: int = MOST, verify: int = 64) -> DataFrame:
    """nodes: distinct fp, also. Gives links a, b of nodes' names that connect what distances of most or less (and verify or less) connect; its attribute made lists the tables it reads."""
    if not 0 <= most <= 6:
        raise ValueError("links at over 6 bits may share less than two bytes")
    found, rows, made = None, keyed(nodes.select("fp", "also"), most), []
    while True:
        key = [F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")).alias("value")]
        hot = store(rows.groupBy(*key).count().where((F.col("count") > limit) & (F.bit_count("mask") < 64 - LEAST_FREE)).select("mask", "value"), "hot")
        made.append(hot)
        n = hot.count()
        if not n:
            now = compare(rows, most, verify)
            out = found.unionByName(now) if found is not None else now
            out.made = made
            return out
        small = F.broadcast(hot) if n <= HOT_KEYS else hot
        on = (F.col("r.mask") == F.col("h.mask")) & (F.col("r.fp").bitwiseAND(F.col("r.mask")) == F.col("h.value"))
        now = store(compare(rows.alias("r").join(small.alias("h"), on, "left_anti"), most, verify), "links")
        made.append(now)
        found = found.unionByName(now) if found is not None else now
        rows = keyed(rows.alias("r").join(small.alias("h"), on, "left_semi").distinct(), most)


def classes(prints: DataFrame, by: list[str], least: Column, named: str, limit: int, most: int, verify: int = 64) -> DataFrame:
    """by (the columns of prints that are a node's fingerprints) and named: the smallest of least over the class of each node."""
    also = F.col(by[1]) if len(by) > 1 else F.lit(0).cast("long")
    nodes = store(prints.groupBy(*by).agg(least.alias("least")).select(F.col(by[0]).alias("fp"), also.alias("also"), "least"), "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, other = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node_name(fp, other, verify))], names=["fp", "also", "least", "node"])

    linked = links(nodes, limit, most, verify)
    found = store(components(linked), "components")
    discard(*linked.made)
    joined = nodes.mapInArrow(run, StructType([*nodes.schema, StructField("node", LongType())])).join(found, "node", "left")
    joined = store(joined.select("fp", "also", "least", F.coalesce("root", "node").alias("root")), "roots")
    # stored, so that the join below reads plain shuffles (or a small table), which Spark splits where a class is large
    of_root = store(joined.groupBy("root").agg(F.min("least").alias(named)), "of_root")
    out = store(joined.join(of_root, "root").select(*[F.col(a).alias(b) for a, b in zip(("fp", "also"), by)], named), "labels")
    discard(nodes, found, joined, of_root)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """id, fp long, component_id (the smallest id that links reach), for every row of df."""
    prints = store(fingerprints(df, id_col, text_col), "fingerprints")
    labels = classes(prints, ["fp"], F.min(f"`{id_col}`"), "component_id", limit, most)
    return prints.join(labels, "fp").select(f"`{id_col}`", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most: int = NEAR, verify: int = VERIFY) -> DataFrame:
    """df without near-duplicates: of each class one row stays, that with the smallest id (nulls last), of equal ids that with the smallest hash of its columns.

    Classes are made of links at `most` bits of the words' fingerprint and `verify` of the shingles'. Only fingerprints,
    ids and hashes take part; the rows are joined to what stays.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        one, two = zip(*map(word_prints, texts))
        return [signed(one), signed(two)]

    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    hashed = beside(df, text_col, run, "fp long, fp2 long")
    rank = F.struct(F.col("row")[id_col].isNull().alias("no_id"), F.col("row")[id_col].alias("id"), F.xxhash64(*[F.col("row")[c] for c in plain]).alias("hash"))
    prints = store(hashed.select("fp", "fp2", rank.alias("rank")), "fingerprints")
    labels = classes(prints, ["fp", "fp2"], F.min("rank"), "rank", limit, most, verify)
    kept = store(labels.select("rank").distinct(), "kept")
    repeated = prints.groupBy("rank").count().where("count > 1").limit(1).count() > 0
    discard(prints, labels)
    i, h = (f"_{x}_{uuid.uuid4().hex}" for x in ("id", "hash"))  # no name of df
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(f"{h}_of") == F.col(h))
    rows = df.withColumn(f"{h}_of", F.xxhash64(*[F.col(f"`{c}`") for c in plain])).join(kept.select(F.col("rank.id").alias(i), F.col("rank.hash").alias(h)), on, "left_semi")
    if repeated:  # rows that are equal in all columns
        rows = rows.dropDuplicates([id_col, f"{h}_of"])
    return rows.drop(f"{h}_of")
