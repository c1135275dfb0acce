"""Inherently sequential operators: each is a fold in order within its key, with the key's rows in one group."""

from __future__ import annotations

import math
import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpointed
from ..functions import hashing


def admitted(times: list[float], n: int, window: float) -> list[bool]:
    """Sliding-window admission of times in order: refused if the n-th last admitted one lies within the window before it."""
    passed: list[float] = []
    out = []
    for t in times:
        out.append(n > 0 and (len(passed) < n or t - passed[-n] > window))
        passed += [t] if out[-1] else []
    return out


def rate_limit(requests: DataFrame, key: str, seconds: str, row_id: str, n: int, window: float) -> DataFrame:
    """Add ``accepted`` per key (T1, W11). Only the key, time and id of a request are shuffled."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([seconds, row_id])
        return rows.assign(accepted=admitted(rows[seconds].tolist(), n, window))

    narrow = requests.select(key, seconds, row_id)
    schema = f"{key} {narrow.schema[key].dataType.simpleString()}, {seconds} double, {row_id} long, accepted boolean"
    return narrow.groupBy(key).applyInPandas(fold, schema)


def lru_hits(keys: list, size: int) -> list[bool]:
    """Whether each access finds its key in a cache of the least recently used kind."""
    cache: OrderedDict = OrderedDict()
    out = []
    for k in keys:
        out.append(k in cache)
        cache[k] = None
        cache.move_to_end(k)
        if len(cache) > size:
            cache.popitem(last=False)
    return out


def lru(accesses: DataFrame, part: str, order: str, key: str, size: int) -> DataFrame:
    """Add ``hit`` for a cache of each partition key."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(hit=lru_hits(rows[key].tolist(), size))

    narrow = accesses.select(part, order, key)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema) + ", hit boolean"
    return narrow.groupBy(part).applyInPandas(fold, schema)


def batch_numbers(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Number of the batch of each size, in the given order: a batch ends before its padded size would pass the budget.

    From the first row of a batch a running maximum over as many rows as could fit tells where the next one begins.
    """
    out, begin, number = np.zeros(len(sizes), np.int64), 0, 0
    while begin < len(sizes):
        ahead = np.maximum.accumulate(sizes[begin : begin + budget // max(1, int(sizes[begin])) + 2])
        over = np.flatnonzero(ahead[1:] * np.arange(2, len(ahead) + 1) > budget)
        end = begin + 1 + int(over[0]) if len(over) else begin + len(ahead)
        out[begin:end] = number
        begin, number = end, number + 1
    return out


def token_batches(rows: DataFrame, group: str, size: str, row_id: str, budget: int) -> DataFrame:
    """Within each group, rows by size in batches whose padded size keeps to the budget (T5)."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([size, row_id])
        return part.assign(batch=batch_numbers(part[size].to_numpy(), budget))

    return rows.select(group, size, row_id).groupBy(group).applyInPandas(fold, f"{group} long, {size} long, {row_id} long, batch int")


def fill_quotas(shares: np.ndarray, ties: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """For each row the index of the allowed value that is furthest below its share; of equal ones that with the smallest tie.

    ``ties`` and ``allowed`` are (rows, values); a row that allows nothing may take any.
    """
    given, picks = np.zeros(len(shares)), np.zeros(len(ties), np.int64)
    for row in range(len(ties)):
        ahead = np.round(given - shares * (row + 1), 9)
        if allowed[row].any():
            ahead[~allowed[row]] = np.inf
        first = np.flatnonzero(ahead == ahead.min())
        picks[row] = first[ties[row, first].argmin()]
        given[picks[row]] += 1
    return picks


def quota_plan(rows: DataFrame, row_id: str, weights: dict[str, float], excluded: str | None = None) -> DataFrame:
    """One value for each row, filling quotas greedily over all rows in the order of their ids.

    Global by definition: the fold has one state. Only ids, ties and exclusions pass through it; its result is one narrow
    column, to be joined back.
    """
    values, shares = np.array(list(weights)), np.array(list(weights.values()))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(row_id)
        ties = np.array([[int(h, 16) for h in row] for row in part["ties"]], np.uint64)
        allowed = np.ones(ties.shape, bool) if excluded is None else part[excluded].to_numpy()[:, None] != values[None, :]
        return pd.DataFrame({row_id: part[row_id], "value": values[fill_quotas(shares, ties, allowed)]})

    ties = F.array(*(hashing.order_key(F.col(row_id).cast("string"), v) for v in weights)).alias("ties")
    narrow = rows.select(row_id, *([excluded] if excluded else []), ties, F.lit(0).alias("one"))
    return narrow.groupBy("one").applyInPandas(fold, f"{row_id} long, value string")


def accepted_texts(texts: list[str], threshold: float = 0.8) -> list[bool]:
    """Whether each text is no near duplicate of one accepted before it: Jaccard of word sets below the threshold."""
    sets, out = [], []
    for t in texts:
        words = set(t.lower().split())
        fresh = all(len(words & s) < threshold * len(words | s) for s in sets if words | s)
        out.append(fresh)
        if fresh:
            sets.append(words)
    return out


#: Buckets of the words' counts, and cells of parities of a set.
BUCKETS, CELLS = 1 << 17, 1 << 10


def _hashed(text: str | None) -> np.ndarray:
    words = set((text or "").lower().split())
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for words in batch.column("w"):
            np.add.at(counts, (np.frombuffer(words.as_py(), np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


#: Sets that are looked up at once, pairs that are held against each other at once, and parts of the index that are merged apart.
BATCH, PAIRS, PARTS = 512, 1 << 20, 32
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _odd(sets: list[np.ndarray]) -> np.ndarray:
    """Which cells of each set hold an odd number of its words, as bits."""
    cells = np.concatenate([((s >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64) + k * CELLS for k, s in enumerate(sets)])
    return np.packbits((np.bincount(cells, minlength=len(sets) * CELLS) & 1).astype(np.uint8).reshape(-1, CELLS), axis=1).view(np.uint64)


def _bounds(part: int) -> np.ndarray:
    """Where a part of the index begins and the next one does (for the last, its largest place)."""
    return np.array([part * (1 << 64) // PARTS, min((part + 1) * (1 << 64) // PARTS, (1 << 64) - 1)], np.uint64)


class Accepted:
    """Sets of words (as hashes, rarest first) of which no two are near; finds those near new ones, a batch at a time.

    Two near sets have a word in common among the first of both, of so many as the threshold lets differ, and their sizes are of the
    same or of neighbouring classes; parities of the words' cells pass over most sets that only share such a word. The index has 32 bits of
    such a word and class with the number of a set, as one long in sorted runs (words that share these bits only cost a comparison). Whole
    sets are in a nameless file on the local disk, so memory holds eight bytes for each of the first words and the cells of a set.
    """

    def __init__(self, threshold: float):
        self.threshold, self.count = threshold, 0
        self.step = math.log(1 / threshold) + 1e-3 if threshold < 1 else 1.0
        self.sizes, self.ends, self.odd = np.zeros(64, np.int64), np.zeros(65, np.int64), np.zeros((64, CELLS // 64), np.uint64)
        self.runs: list[list[np.ndarray]] = [[] for _ in range(PARTS)]
        self.words = tempfile.TemporaryFile(buffering=0, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)

    @property
    def places(self) -> dict[int, np.ndarray]:
        """The numbers of the sets at each place of the index."""
        flat = np.sort(np.concatenate([np.zeros(0, np.uint64), *(r for part in self.runs for r in part)]))
        at, begins = np.unique(flat >> np.uint64(32), return_index=True)
        return dict(zip(at.tolist(), np.split(flat & _LOW, begins[1:]), strict=False))

    def add(self, words: np.ndarray) -> bool:
        """Whether a set that is not empty is near none before it; then it is kept."""
        return self.extend([words])[0]

    def extend(self, sets: list[np.ndarray]) -> list[bool]:
        """The same for some sets in order."""
        firsts: dict[bytes, int] = {}
        for k, s in enumerate(sets):  # of equal sets only the first can be kept
            firsts.setdefault(s.tobytes(), k)
        left, out = list(firsts.values()), [False] * len(sets)
        some = [sets[k] for k in left]
        sizes, odd = np.array([len(s) for s in some], np.int64), _odd(some)
        near = np.zeros(len(some), bool)
        places, asked = self._places(some, sizes)
        for x, y in self._possible(asked, [(k, r) for k, part in enumerate(self.runs) for r in part], sizes, odd, self.sizes, self.odd, False):
            near[x] = near[x] or self._alike(some[x], self._read(y))
        places, asked = (v[~near[(v & _LOW).astype(np.int64)]] for v in (places, asked))
        for x, y in self._possible(asked, [(None, places)], sizes, odd, sizes, odd, True):
            near[x] = near[x] or (not near[y] and self._alike(some[x], some[y]))
        fresh = np.flatnonzero(~near)
        self._keep([some[k] for k in fresh], sizes[fresh], odd[fresh], places[~near[(places & _LOW).astype(np.int64)]], fresh)
        for k in fresh:
            out[left[k]] = True
        return out

    def _places(self, some: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some sets, the sorted places that they take and those that they look up, each with the number of the set."""
        leads = sizes - np.maximum(1, np.ceil(self.threshold * sizes - 1e-9).astype(np.int64)) + 1
        words, own = np.concatenate([s[:n] for s, n in zip(some, leads, strict=True)]), np.repeat(np.arange(len(some)), leads)
        of = (np.log(sizes) / self.step).astype(np.int64)[own]
        with np.errstate(over="ignore"):
            at = [((words + (of + c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) & _HIGH) | own.astype(np.uint64) for c in (0, -1, 1)]
        return np.sort(at[0]), np.sort(np.concatenate(at))

    def _possible(self, asked: np.ndarray, runs: list, sizes: np.ndarray, odd: np.ndarray, their_sizes: np.ndarray, their_odd: np.ndarray, before: bool) -> Iterator[tuple[int, int]]:
        """Pairs that share a place and whose parities allow a near pair, by the first and then the likest first."""
        hits, found = [np.zeros((4, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        for number, (part, run) in enumerate(runs):
            ask = asked if part is None else asked[slice(*np.searchsorted(asked, _bounds(part)))]
            low = np.searchsorted(run, ask & _HIGH)
            hit = np.flatnonzero(low < len(run))
            hit = hit[(run[low[hit]] ^ ask[hit]) <= _LOW]
            ask, low = ask[hit], low[hit]
            hits.append(np.stack([(ask & _LOW).astype(np.int64), np.full(len(ask), number), low, np.searchsorted(run, ask | _LOW, side="right") - low]))
        asker, of, low, n = (both := np.concatenate(hits, axis=1))[:, np.lexsort((both[1], both[0]))]
        total = np.cumsum(n)
        cuts = np.unique([0, *(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1), len(n)]).tolist() if len(n) else []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            pairs = []
            for number in np.unique(of[begin:end]):
                k = begin + np.flatnonzero(of[begin:end] == number)
                each = np.repeat(low[k] - np.cumsum(n[k]) + n[k], n[k]) + np.arange(n[k].sum())
                pairs.append(np.repeat(asker[k] << 32, n[k]) | (runs[number][1][each] & _LOW).astype(np.int64))
            pairs = np.unique(np.concatenate(pairs))
            for c in range(0, len(pairs), 1 << 16):
                x, y = pairs[c : c + (1 << 16)] >> 32, pairs[c : c + (1 << 16)] & 0xFFFFFFFF
                if before:
                    x, y = x[y < x], y[y < x]
                apart = np.bitwise_count(odd[x] ^ their_odd[y]).sum(1).astype(np.int64)  # at most what the sets differ in
                fits = apart * (1 + self.threshold) <= (sizes[x] + their_sizes[y]) * (1 - self.threshold) + 1e-6
                found.append(np.stack([x[fits], apart[fits], y[fits]]))
        x, apart, y = (both := np.concatenate(found, axis=1))[:, np.lexsort((both[2], both[1], both[0]))]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield from zip(x[new].tolist(), y[new].tolist(), strict=True)

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.threshold * (len(a) + len(b) - both)

    def _read(self, number: int) -> np.ndarray:
        return np.frombuffer(os.pread(self.words.fileno(), int(8 * self.sizes[number]), int(8 * self.ends[number])), np.uint64)

    def _keep(self, some: list[np.ndarray], sizes: np.ndarray, odd: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> None:
        """Store sets, whose places have them under other numbers."""
        if not some:
            return
        begin, end = self.count, self.count + len(some)
        if end > len(self.sizes):  # grown in place, a quarter at a time
            more = max(end, len(self.sizes) * 5 // 4)
            self.sizes.resize(more, refcheck=False)
            self.ends.resize(more + 1, refcheck=False)
            self.odd.resize((more, CELLS // 64), refcheck=False)
        self.sizes[begin:end], self.odd[begin:end], self.count = sizes, odd, end
        self.ends[begin + 1 : end + 1] = self.ends[begin] + np.cumsum(sizes)
        data = memoryview(np.concatenate(some)).cast("B")
        while data:
            data = data[self.words.write(data) :]
        new = places & _HIGH | (np.searchsorted(numbers, (places & _LOW).astype(np.int64)) + begin).astype(np.uint64)
        for k, runs in enumerate(self.runs):
            runs.append(new[slice(*np.searchsorted(new, _bounds(k)))].copy())
            while len(runs) > 1 and len(runs[-2]) <= 4 * len(runs[-1]):
                runs[-2:] = [np.concatenate(runs[-2:])]
                runs[-1].sort(kind="stable")


def without_near_duplicates(rows: DataFrame, group: str, order: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Rows of each group in order, without near duplicates of accepted ones (P25, J13), up to 64-bit hash collisions.

    Texts become hashes of words in all tasks. The fold of a group is sequential; it gets these hashes in order, a batch at a time, and
    looks accepted ones up by their rarest words, with their whole sets on the local disk. Rows without words are all kept.
    """
    texts = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text).alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([_hashed(t.as_py()).tobytes() for t in some.column("t")], pa.binary())], names=["g", "o", "t", "w"])

    schema = T.StructType([*texts.schema.fields, T.StructField("w", T.BinaryType())])
    sets = checkpointed(texts.mapInArrow(scan, schema).withColumn("key", F.monotonically_increasing_id()))
    some = sets.where(F.octet_length("w") > 0).select("g", "o", "key", "w")
    counts = np.zeros(BUCKETS, np.int64)
    for r in some.select("w").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    rarity = rows.sparkSession.sparkContext.broadcast(counts)

    def order_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                found = [np.frombuffer(w.as_py(), np.uint64) for w in some.column("w")]
                words = [w[np.lexsort((w, rarity.value[(w % np.uint64(BUCKETS)).astype(np.int64)]))].tobytes() for w in found]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(words, pa.binary())], names=["g", "o", "key", "w"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, object()
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                some, kept = batch.slice(begin, BATCH).to_pylist(), []
                for g, rows in groupby(some, lambda r: r["g"]):
                    if held is None or g != own:
                        held, own = None, g  # the one before goes first
                        held = Accepted(threshold)
                    rows = list(rows)
                    kept += [r["key"] for r, ok in zip(rows, held.extend([np.frombuffer(r["w"], np.uint64) for r in rows]), strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["key"])

    ordered = some.mapInArrow(order_words, some.schema)
    keys = ordered.repartition("g").sortWithinPartitions("g", F.col("o").asc_nulls_last(), "key").mapInArrow(fold, "key long")
    kept = sets.where(F.octet_length("w") == 0).unionByName(sets.join(keys, "key", "left_semi").select(*sets.columns))
    return kept.select(F.col("g").alias(group), F.col("o").alias(order), F.col("t").alias(text))
