"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its word shingles, as 64-bit hashes; equal sets are one node. Two nodes link when the Jaccard
similarity of their sets is ``per_cent`` or more, compared in whole numbers.

Candidates come from signatures. Tokens are ordered by hash. The prefix of a set of n tokens are its first
n - ceil(t n) + 1; two similar sets share a token there. A token that only two nodes have in their prefixes is rare, and
serves alone. For all more frequent ones the prefix is extended, to the whole set, and tokens are combined: sets of
one size class differ in at most d tokens, so of d + 1 + s ranges of hashes at least s + 1 hold the same tokens in both,
and the combination of all tokens of a range (seven to nine on average) is indexed as one signature. Ranges that
happen to hold less than two tokens are left out by sets that have at most s of them: of s + 1 equal ranges one remains. A set near
the end of its size class is also indexed in the next (at low thresholds in several). So every linked pair shares a signature of one kind or the other, while sets that merely share a
frequent passage do not.

Ranges hold so many tokens only at high thresholds. Below ``DIRECT`` per cent prefixes are extended by a tenth of the set, so
similar sets share at least that many tokens there. If one of them is rare, it serves alone. Otherwise all are frequent, and both
sets are dense: they have that many frequent tokens in their extended prefixes. Only dense sets combine tokens, in ranges of twice
the length: of d / 2 + 1 + 2 s of them at least 2 s + 1 differ in at most one token, so a range is indexed whole and without each
of its tokens in turn. A set leaves out up to s ranges of less than two tokens.

Each signature connects its nodes to the smallest of them (not each to each). Pairs from single tokens are first held
against the sizes and the counts of tokens in sixty-four cells of both sides, whose distance is at most that of the sets. The connected
candidates then meet in families, where an inverted index over the tokens of a family gives the intersections of its sets. A
large family is dealt out by size: a size class holds what may be similar in size, and only pairs of blocks of the same or of neighbouring
classes meet. Verified links give the components.

Scale: signatures are hashes, counted with partial aggregation, and only those of two nodes or more are joined back (a join
that AQE can split). Rows are numbered once, in a staged copy, as a table read again may be dealt to other partitions. Texts are shuffled once, by that number, to reach the candidates; the texts of candidates once
more, to their families (in a large family once for each block of the classes around theirs). A group of equal copies of any size is one node. No pair of documents is a row until it is verified,
and of the verified links a family returns a spanning forest.

Cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer words than a shingle is one
shingle; very long texts are read whole; repeated rows are copies of each other; a null id has no say in component ids; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import col, fresh, hand_on, scratch, slices, staged

LANES = 64
COUNTS = [f"h{k}" for k in range(LANES // 4)]
GROWTH = 1.25
#: From this threshold on, ranges of equal tokens are long enough to be indexed for all sets.
DIRECT = 90
#: A range with fewer tokens says little; such ranges are left out where enough others are sure to remain.
SPARSE = 2
_A, _B, _C, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words, up to a bound."""

    def __init__(self, width: int, most: int = 120_000):
        self.width, self.most, self.memory = width, most, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memory = self.memory
        if len(memory) > self.most:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((memory[w] for w in words), np.uint64, len(words))
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, np.uint64(k if k < self.width else 0) * _C)
            for j in range(k):
                total = mix(total * _A + h[j : len(h) - k + 1 + j] * _B + np.uint64(j))
        return np.unique(total)


def size_classes(least: int) -> list[int]:
    """Where size classes begin; the last is beyond any text."""
    edges = [least]
    while edges[-1] < 1 << 31:
        edges.append(int(edges[-1] * GROWTH) + 1)
    return edges


def own_classes(n: int, per_cent: int, edges: list[int]) -> list[int]:
    """The classes of all sets that are not smaller than one of n and may be similar to it."""
    own = last = int(np.searchsorted(edges, n, side="right")) - 1
    while last + 1 < len(edges) and 100 * n >= per_cent * edges[last + 1]:
        last += 1
    return list(range(own, last + 1))


@lru_cache(maxsize=None)
def spare_ranges(differing: int, least: int) -> int:
    """How many ranges to add, so that sets of ``least`` tokens rarely have more sparse ranges than that.

    None if that number does not settle: at low thresholds ranges are short, and all of them are kept.
    """
    spare = 0
    for _ in range(30):
        if spare > differing // 2:
            return 0
        ranges = differing + 1 + spare
        mean = least / ranges
        spare = int(1.15 * ranges * np.exp(-mean) * (1 + mean)) + 1
    return spare if differing >= 4 else 0


def signatures(tokens: np.ndarray, per_cent: int, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Single-token signatures of the prefix and combination signatures of the extended prefix."""
    n = len(tokens)
    if n < edges[0]:  # smaller sets are similar only if they are equal
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    single = tokens[: n - (-(-per_cent * n // 100)) + 1]
    combined = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens))])
        for c in own_classes(n, per_cent, edges):
            differing = 2 * (edges[c + 1] - 1) * (100 - per_cent) // (100 + per_cent)
            spare = spare_ranges(differing, edges[c])
            ranges = differing + 1 + spare
            at = np.searchsorted((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            place = np.arange(ranges, dtype=np.uint64) + np.uint64(c << 40)
            whole, full = mix(sums[at[1:]] - sums[at[:-1]] + mix(place + _C)), np.diff(at) >= SPARSE
            combined.append(whole[full] if ranges - full.sum() <= spare else whole)
    return single, np.concatenate(combined)


def extended_prefix(tokens: np.ndarray, per_cent: int, least: int) -> np.ndarray:
    """The prefix of a set and a tenth of the set more; similar sets share ``common_least`` tokens there."""
    n = len(tokens)
    return tokens[: n - (-(-per_cent * n // 100)) + max(1, n // 10)] if n >= least else tokens[:0]


def common_least(n: Column, per_cent: int) -> Column:
    """How many tokens the extended prefix of a set of n shares with that of any similar set, at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * per_cent / 100) / 10))


@lru_cache(maxsize=None)
def spare_wide_ranges(differing: int, least: int) -> int:
    """How many sparse wide ranges a set may leave out: what sets of ``least`` tokens have, and two deviations."""
    spare = 0
    for _ in range(30):
        if 2 * spare > differing // 2:
            return 0
        ranges = differing // 2 + 1 + 2 * spare
        mean = least / ranges
        expected = ranges * np.exp(-mean) * (1 + mean)
        spare = int(expected + 2 * np.sqrt(expected)) + 1
    return spare if differing >= 4 else 0


def wide_signatures(tokens: np.ndarray, per_cent: int, edges: list[int]) -> np.ndarray:
    """Combinations of the tokens of each wide range: all of them, and all but one."""
    n = len(tokens)
    if n < edges[0]:
        return np.zeros(0, np.uint64)
    mixed, found = mix(tokens), []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        for c in own_classes(n, per_cent, edges):
            differing = 2 * (edges[c + 1] - 1) * (100 - per_cent) // (100 + per_cent)
            spare = spare_wide_ranges(differing, edges[c])
            ranges = differing // 2 + 1 + 2 * spare
            at = np.searchsorted((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            held = np.diff(at)
            total = sums[at[1:]] - sums[at[:-1]] + mix(np.arange(ranges, dtype=np.uint64) + np.uint64(c << 40) + _C)
            full = held >= SPARSE
            keep = full if ranges - full.sum() <= spare else np.ones(ranges, bool)
            without = (np.repeat(total, held) - mixed)[np.repeat(keep, held)]
            found += [mix(total[keep]), mix(without)]
    return np.unique(np.concatenate(found))


def lanes(tokens: np.ndarray) -> np.ndarray:
    """Counts of tokens by their last bits, four to a long; a count stops at 32767."""
    counts = np.minimum(np.bincount((tokens & np.uint64(LANES - 1)).astype(np.int64), minlength=LANES), 32767)
    return (counts.reshape(-1, 4) << np.array([0, 16, 32, 48])).sum(1)


def _scan(width: int, per_cent: int, edges: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, longs = Shingles(width), pa.list_(pa.int64())
        for some in slices(batches, "text", rows=250, size=2 << 20):
            sets = [shingles(t or b"") for t in some.column("text").cast(pa.binary()).to_pylist()]
            signs = [signatures(s, per_cent, edges) if per_cent >= DIRECT else (extended_prefix(s, per_cent, edges[0]), s[:0]) for s in sets]
            nodes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            four = np.stack([lanes(s) for s in sets])
            columns = [some.column("row_key"), some.column("doc_id"), some.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), *(pa.array(four[:, k]) for k in range(LANES // 4))]
            columns += [pa.array([s[k].view(np.int64) for s in signs], longs) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", "mark", "n", "node", *COUNTS, "single", "combined"])

    return run


SCAN = "row_key long, doc_id long, mark long, n long, node long, " + "".join(f"{c} long, " for c in COUNTS) + "single array<long>, combined array<long>"


def _combine(width: int, per_cent: int, edges: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for some in slices(batches, "text", rows=250, size=2 << 20):
            signs = [wide_signatures(shingles(t or b""), per_cent, edges).view(np.int64) for t in some.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(signs, pa.list_(pa.int64()))], names=["node", "combined"])

    return run


def _near(per_cent: int) -> Column:
    """Whether the counts of both sides (a_, b_) allow a similar pair."""
    lane = lambda side, k: F.shiftright(F.col(f"{side}_h{k // 4}"), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
    apart = sum((F.abs(lane("a", k) - lane("b", k)) for k in range(1, LANES)), F.abs(lane("a", 0) - lane("b", 0)))
    sizes = F.col("a_n") + F.col("b_n")
    return (100 * F.least("a_n", "b_n") >= per_cent * F.greatest("a_n", "b_n")) & (apart * (100 + per_cent) <= sizes * (100 - per_cent))


def family_links(nodes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, per_cent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among some sets, and for each the documents that it links with.

    ``side`` is 0 for all sets to compare each with each, or 1 and 2 to compare across only. Intersections come from
    an inverted index over the tokens that more than one of the sets have.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, token, count = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], token[shared]
    begin_own = np.searchsorted(owner, np.arange(m + 1))
    order = np.argsort(token, kind="stable")
    posting, sorted_token = owner[order], token[order]
    first, last = np.searchsorted(sorted_token, token), np.searchsorted(sorted_token, token, side="right")
    parent, edges, degree = list(range(m)), [], np.zeros(m, np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(m):
        mine = range(begin_own[x], begin_own[x + 1])
        if not mine:
            continue
        inter = np.bincount(np.concatenate([posting[first[k] : last[k]] for k in mine]), minlength=m)
        linked = (100 * inter >= per_cent * (sizes[x] + sizes - inter)) & ((side == 0) | (side != side[x]))
        linked[x] = False
        degree[x] = copies[linked].sum()
        for y in np.flatnonzero(linked[:x]):  # the other half has met or will meet this one
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(nodes[x]), int(nodes[y])))
    return edges, degree


def _verify(width: int, per_cent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shingles, out = Shingles(width), []
        for _, family in rows.groupby("family", sort=False):
            sets = [shingles(t.encode()) for t in family["text"]]
            nodes = family["node"].to_numpy()
            if any(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) != n for s, n in zip(sets, nodes, strict=True)):
                raise RuntimeError("the documents are not the same in two passes")
            side = np.where(family["left"] == family["right"], 0, np.where(family["own"] == family["left"], 1, 2))
            edges, degree = family_links(nodes, sets, family["copies"].to_numpy(), side, per_cent)
            out += [(u, v, 0) for u, v in edges] + [(int(n), int(n), int(d)) for n, d in zip(nodes, degree, strict=True)]
        return pd.DataFrame(out, columns=["u", "v", "links"])

    return run


def join(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1000, batch: int = 500) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links and first of every row.

    Rows are numbered once and staged with their numbers: a table that is read again may be dealt to other partitions, as their
    number hangs on the cores that the cluster has at the moment. ``first`` marks one row of each component, the first of the input; ``block``
    bounds the sets of a class of a family that one task compares with each other, ``batch`` the rows of small families in one group.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), col(id_col).cast("long").alias("doc_id"), _mark(id_col, text_col).alias("mark"), col(text_col).alias("text"))
    return _joined(rows, width, per_cent, block, batch, True).drop("row_key", "mark")


def deduplicate(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows and columns of ``docs`` without all but one row of each component; rows without shingles all stay."""
    bounds = {"block": 1000, "batch": 500} | bounds
    key, own, mark = fresh(docs.columns, "__row_key", "__own", "__mark")
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    with scratch():
        rows = numbered.select(col(key).alias("row_key"), col(id_col).cast("long").alias("doc_id"), _mark(id_col, text_col).alias("mark"), col(text_col).alias("text"))
        others = _joined(rows, width, per_cent, **bounds, stage=False).where("not first")
        others = hand_on(staged(others.select(F.col("row_key").alias(key), F.col("mark").alias(mark)), "copies"))
    same = F.when(col(mark) == col(own), False).otherwise(F.raise_error(F.lit("the documents are not the same in two passes")).cast("boolean"))
    numbered = numbered.withColumn(own, _mark(id_col, text_col))
    kept = numbered.join(others.hint("shuffle_hash"), key, "left").where(F.when(col(mark).isNull(), True).otherwise(same))
    return kept.select(*(col(c) for c in docs.columns))


def _mark(id_col: str, text_col: str) -> Column:
    """A hash by which a later pass knows a row again."""
    return F.xxhash64(col(id_col).cast("long"), col(text_col))


def _possible(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (lo, hi) of nodes whose sizes and counts allow a link, as (u, v)."""
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("n", *COUNTS)]
    both = pairs.join(nodes.select(F.col("node").alias("lo"), *side("a")), "lo").join(nodes.select(F.col("node").alias("hi"), *side("b")), "hi")
    return both.where(_near(per_cent)).select(F.col("lo").alias("u"), F.col("hi").alias("v"))


def _connect_all(full: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Edges (u, v) that connect all candidates, by combinations of all sets."""
    # Both kinds of signature are counted in one aggregation; a kind is the last bit.
    sign = lambda c, bit: F.transform(c, lambda x: x.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    combined = full.select("node", F.explode(sign("combined", 1)).alias("sig"))
    both = full.select("node", F.explode(F.concat(sign("single", 0), sign("combined", 1))).alias("sig"))
    shared = staged(both.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "signatures")
    rare = _possible(shared.where("sig % 2 = 0").select("lo", "hi").distinct(), nodes, per_cent)
    stars = combined.join(shared.where("sig % 2 != 0").select("sig", "lo"), "sig").where("node != lo").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    return rare.unionByName(stars)


def _connect_dense(full: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, per_cent: int, edges: list[int]) -> DataFrame:
    """Edges (u, v) that connect all candidates, by rare tokens and combinations of dense sets."""
    # One row for each node, so that a count is one of different sets and a group of copies counts once.
    sets = staged(full.join(nodes.select("row_key").hint("shuffle_hash"), "row_key", "left_semi").select("node", "n", "single"), "sets")
    count = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("sets")]
    tokens = sets.select("node", F.explode("single").alias("sig"))
    shared = staged(tokens.groupBy("sig").agg(*count).where("sets > 1"), "tokens")
    met = tokens.join(shared.where("sets > 2").select("sig"), "sig").groupBy("node").agg(F.count(F.lit(1)).alias("frequent"))
    dense = met.join(nodes.select("node", "n", "row_key"), "node").where(F.col("frequent") >= common_least(F.col("n"), per_cent))
    dense = staged(dense.select("node", "row_key"), "dense")
    texts = rows.select("row_key", "text").join(dense.hint("shuffle_hash"), "row_key").select("node", "text")
    combined = staged(texts.mapInArrow(_combine(width, per_cent, edges), "node long, combined array<long>"), "combined").select("node", F.explode("combined").alias("sig"))
    wide = staged(combined.groupBy("sig").agg(*count).where("sets > 1"), "combinations")
    rare = _possible(shared.unionByName(wide).where("sets = 2").select("lo", "hi").distinct(), nodes, per_cent)
    stars = combined.join(wide.where("sets > 2").select("sig", "lo"), "sig").where("node != lo").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    return rare.unionByName(stars.distinct())


def _dealt(met: DataFrame, per_cent: int, block: int) -> DataFrame:
    """The candidates (node, row_key, copies, family, n) with the codes of their own block and of all that it meets.

    A family of up to ``block`` sets is one block. Of a larger one, a class holds sizes within a little more than the factor that similar
    sets may differ by, so similar sets are of the same or of neighbouring classes; only such blocks meet.
    """
    met = met.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / per_cent) + 1e-3)).cast("int"))
    classes = met.groupBy("family", "class").agg(F.count(F.lit(1)).alias("sets"))
    large = classes.groupBy("family").agg(F.sum("sets").alias("sets"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("sets") / block).cast("int").alias("blocks")))).alias("blocks"))
    large = staged(large.where(F.col("sets") > block).drop("sets"), "large")  # staged, so that the join of a large family is split
    code = lambda c, b: F.shiftleft(c.cast("long"), 32) + b
    blocks_of = lambda c: F.coalesce(F.try_element_at(F.col("blocks"), c), F.lit(0))
    blocks_in = lambda c: F.when(blocks_of(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(blocks_of(c), F.lit(1))), lambda b: code(c, b))).otherwise(F.array().cast("array<bigint>"))
    around = F.concat(*(blocks_in(F.col("class") + k) for k in (-1, 0, 1)))
    around = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(around)
    own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(code(F.col("class"), F.pmod(F.xxhash64("node"), F.greatest(blocks_of(F.col("class")), F.lit(1))) + 1))
    return met.join(large, "family", "left").select("node", "row_key", "copies", "family", F.col("blocks").isNotNull().alias("split"), own.alias("own"), around.alias("others"))


def _joined(rows: DataFrame, width: int, per_cent: int, block: int, batch: int, stage: bool) -> DataFrame:
    """``join`` of rows with row_key, doc_id, mark and text; with ``stage``, the row keys are not stored yet."""
    if not 1 <= per_cent <= 100:
        raise ValueError("per_cent must be from 1 to 100")
    edges = size_classes(-(-100 // (100 - per_cent)) - 1 if per_cent < 100 else 1 << 30)
    with scratch():
        rows = staged(rows, "rows") if stage else rows
        scan = hand_on(staged(rows.mapInArrow(_scan(width, per_cent, edges), SCAN), "shingles"))
        full = scan.where(F.col("node").isNotNull())
        nodes = full.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), *(F.max(c).alias(c) for c in ("n", *COUNTS)))
        nodes = staged(nodes, "nodes")
        with scratch():
            connected = _connect_all(full, nodes, per_cent) if per_cent >= DIRECT else _connect_dense(full, nodes, rows, width, per_cent, edges)
            families = components(connected).withColumnRenamed("root", "family")
            met = staged(families.join(nodes.select("node", "row_key", "copies", "n"), "node"), "candidates")
            met = hand_on(staged(_dealt(met, per_cent, block), "families"))
        checked = staged(_links(rows, met, width, per_cent, batch), "links")
        known = hand_on(staged(_known(nodes, checked), "known"))  # no aggregation between shuffle and join, so AQE can split a group of copies
    linked = full.select("row_key", "mark", "node", "doc_id", "n").join(known.hint("merge"), "node").select("row_key", "mark", "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", (F.col("row_key") == F.col("first_key")).alias("first"))
    alone = scan.where(F.col("node").isNull()).select("row_key", "mark", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def _links(rows: DataFrame, met: DataFrame, width: int, per_cent: int, batch: int) -> DataFrame:
    """Verified links (u, v, 0), a spanning forest of each block or pair of blocks, and (u, u, number of documents linked with u)."""
    groups = max(1, -(-met.count() // batch))
    texts = rows.select("row_key", "text").join(met.hint("shuffle_hash"), "row_key")
    dealt = texts.withColumn("other", F.explode("others")).withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop("others", "other")
    group = F.when(F.col("split"), F.xxhash64("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(groups)))
    return dealt.withColumn("grp", group).groupBy("grp", F.when(F.col("split"), F.col("family")).alias("big"), "left", "right").applyInPandas(_verify(width, per_cent), "u long, v long, links long")


def _known(nodes: DataFrame, checked: DataFrame) -> DataFrame:
    """node, component_id, first_key, n_links of every node."""
    links = checked.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("u != v").select("u", "v"))
    owned = nodes.select("node", "low", "copies", "row_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = staged(owned.groupBy("root").agg(F.min("low").alias("component_id"), F.min("row_key").alias("first_key")), "lowest")
    return owned.join(lowest, "root").join(links, "node", "left").select("node", "component_id", "first_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
