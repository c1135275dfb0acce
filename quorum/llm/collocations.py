"""Phrase collocation mining: which words belong together, by exact counts of all phrases of two to four words.

A shard of texts becomes one row of word ids for each language, with an id of its own between pieces. Prefix doubling (the rank of a
word, then of two, then of four) sorts its suffixes as far as a phrase reaches; runs of neighbours with a common prefix of m words
are the intervals of the phrases of m words, and their lengths are the counts. Spark sums them by phrase.

Phrases of fewer than ``least`` occurrences matter to nobody, and a phrase of that many consists of words and shorter phrases of that
many. So a first pass counts words and pairs by hashes of 40 bits (eight thousand times the cells of the bit map, which could not hold
more), and those that reach ``least`` are marked in a bit map. Hashes travel with their counts in numbers of 32 bits, many to a row: those of one
part of the bit map, which one call adds up and marks. A second does the same with phrases of three and four words whose words
and pairs are all marked. The last pass counts phrases themselves, those that are marked with all their parts. Collisions mark too
much and never too little: counts are by the phrase, and exact.

Scale: the bit map has ``1 << bits`` bits whatever the input (16 MB); where it fills up, more phrases are shuffled, and the result is the
same. A shard has a bounded number of words; a language of any share of the rows is many shards. Shuffled are some shards'
distinct hashes, then its distinct marked phrases, then the table of frequent ones (joined with itself by phrase). Ranks of a
language are cut to ``top`` in each of ``parts`` parts of it first.

Cases: a null text is empty, a null language is 'und'; texts without words count for nothing; repeated rows count each; a phrase never
crosses a piece or a text; equal scores go by the smaller cut, equal ranks by the phrase's bytes; an empty table gives no rows;
other columns are ignored, whatever their names; a text is held whole by one task, whatever its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_bounded, col, slices, staged

#: Characters that end a piece, all made into the first.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_END = bytes.maketrans(ENDS, ENDS[:1] * len(ENDS))
#: Words of the longest phrase, and bits of the hashes that the first pass counts by.
LONGEST, SIEVE = 4, 40
#: Bits of a hash that choose a part of the bit map, and those that choose a group of parts, which one call adds up.
PART, GROUP = 13, 10


class Shard:
    """The words of one language as ids; 0 stands between pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[ENDS[:1]] = 0
        self.rows: list[np.ndarray] = []
        self.words = 0

    def add(self, text: str) -> int:
        words = text.encode().lower().translate(_TO_END).replace(ENDS[:1], b" . ").split()  # bytes: only A-Z are lowered
        ids = np.array([*map(self.number.__getitem__, words), 0], np.int64)
        self.rows.append(ids)
        self.words += int(np.count_nonzero(ids))
        return len(ids)

    def ids(self) -> np.ndarray:
        """All rows, with room for looking ahead from the last word."""
        return np.concatenate([*self.rows, np.zeros(LONGEST, np.int64)])


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of equal and ordered keys."""
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    new[1:] = np.diff(key[order]) != 0
    rank = np.empty_like(new)
    rank[order] = np.cumsum(new)
    return rank


def suffixes(ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` (of words) in the order of their next ``depth`` (2 or 4) words, and the length of the prefix that each has in
    common with the one before it. Words after the end of the piece count as 0."""
    word = ids[:-LONGEST]
    pair = word * (int(ids.max()) + 1) + np.where(word > 0, ids[1 : 1 + len(word)], 0)
    if depth == 2:
        key = pair[at]
    else:
        rank = np.concatenate([np.where(word > 0, _dense(pair), 0), np.zeros(LONGEST, np.int64)])
        inside = ids[at + 1] > 0  # otherwise the second pair is another piece's
        key = rank[at] * (int(rank.max()) + 1) + np.where(inside, rank[at + 2], 0)
    sa = at[np.argsort(key)]
    lcp, same = np.zeros(len(sa), np.int64), np.ones(max(len(sa) - 1, 0), bool)
    for t in range(depth):
        same &= (ids[sa[1:] + t] == ids[sa[:-1] + t]) & (ids[sa[1:] + t] > 0)
        lcp[1:] += same
    return sa, lcp


def intervals(sa: np.ndarray, lcp: np.ndarray, room: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the count of each phrase of m words; ``room`` has how long phrases at a place may get."""
    starts = np.flatnonzero(lcp < m)
    counts = np.diff(np.append(starts, len(sa)))
    keep = room[sa[starts]] >= m
    return sa[starts][keep], counts[keep]


def hashes(shard: Shard, lang: str, ids: np.ndarray, longest: int = LONGEST) -> list[np.ndarray]:
    """64-bit hashes of the phrases of one word, two and so on to ``longest`` that begin at each place."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    word = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in shard.number], np.uint64)[ids]
    out = [word[:-LONGEST]]
    for m in range(1, longest):
        following = word[m : m - LONGEST]
        mixed = (out[-1] * np.uint64(0x9E3779B97F4A7C15) ^ (following >> np.uint64(29))) + following * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


def rooms(ids: np.ndarray, hashed: list[np.ndarray], marks: np.ndarray | None, known: int, bits: int) -> np.ndarray:
    """How long phrases at each place may get: inside their piece, and with all parts of up to ``known`` words marked."""
    fine = ids > 0
    room = np.zeros(len(ids), np.int64)
    for m in range(1, LONGEST + 1):
        if m > 1:
            fine = fine & np.append(fine[1:], False)  # both phrases that are a word shorter
        if m <= known:
            fine[:-LONGEST] &= _marked(marks, hashed[m - 1], bits)
        room += fine
    return room


def _shards(batches: Iterator[pa.RecordBatch], words: int, use: Callable[[str, Shard], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Gather texts to shards of about so many words and hand each language's on."""
    held, room = defaultdict(Shard), words
    for batch in slices(batches, "text", rows=1024, size=4 << 20):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            room -= held[lang].add(text)
            if room <= 0:
                for key, shard in held.items():
                    yield from use(key, shard)
                held, room = defaultdict(Shard), words
    for key, shard in held.items():
        yield from use(key, shard)


def _layout(bits: int, most: int) -> tuple[int, int, type]:
    """How a hash and its count lie in a number: the bits that choose a part (a stretch of the bit map), those of a count, and the type."""
    cut, held = min(PART, bits - 6), max(most.bit_length(), 1)
    return cut, held, np.uint32 if SIEVE - cut + held <= 32 else np.uint64


def combined(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts, which stop at ``most``."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[begins], np.minimum(np.add.reduceat(counts[order], begins), most) if len(keys) else counts


def _sieve(words: int, marks, known: int, least: int, bits: int, most: int = 1 << 21):
    """Hashes of the phrases of the next two lengths whose parts are marked, with their counts, added up over some shards: for each part
    of the bit map that these meet, numbers that hold what is left of the hash and the count (up to ``least``, which decides alike)."""
    cut, held, kind = _layout(bits, least)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def use(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        ids = shard.ids()
        hashed = hashes(shard, lang, ids, known + 2)
        room = rooms(ids, hashed, marks.value if marks else None, known, bits)
        sa, lcp = suffixes(ids, np.flatnonzero(room > known), known + 2)
        for m in (known + 1, known + 2):
            place, n = intervals(sa, lcp, room, m)
            h = hashed[m - 1][place]
            low = h & np.uint64((1 << bits) - 1)  # the part comes first, then the place in it, then the other bits
            rest = (h & np.uint64((1 << SIEVE) - 1)) >> np.uint64(bits)
            waiting.append(((low << np.uint64(SIEVE - bits)) | rest, n))
        if sum(len(k) for k, _ in waiting) >= most:
            yield packed()

    def packed() -> pa.RecordBatch:
        keys, counts = combined(*(np.concatenate(x) for x in zip(*waiting, strict=True)), least)
        waiting.clear()
        part = keys >> np.uint64(SIEVE - cut)
        found, begins = np.unique(part, return_index=True)
        data = ((keys & np.uint64((1 << (SIEVE - cut)) - 1)) << np.uint64(held) | counts.astype(np.uint64)).astype(kind)
        ends = np.append(begins, len(keys)).astype(np.int32) * data.itemsize
        cells = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), cells], names=["part", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting.clear()
        yield from _shards(batches, words, use)
        if waiting:
            yield packed()

    return run


def _stretches(least: int, bits: int):
    """Of each part in a group, the stretch of the bit map in which the frequent hashes are marked."""
    cut, held, kind = _layout(bits, least)

    def run(rows: pa.Table) -> pa.Table:
        held_by = rows.column("numbers").to_pylist()
        numbers = np.frombuffer(b"".join(held_by), kind).astype(np.uint64)
        part = np.repeat(rows.column("part").to_numpy().astype(np.uint64), [len(x) // np.dtype(kind).itemsize for x in held_by])
        keys, counts = combined(part << np.uint64(SIEVE - cut) | numbers >> np.uint64(held), (numbers & np.uint64((1 << held) - 1)).astype(np.int64), least)
        bit = np.unique(keys[counts >= least] >> np.uint64(SIEVE - bits))
        cell, begins = np.unique(bit >> np.uint64(6), return_index=True)
        ones = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), begins) if len(bit) else bit
        return pa.table({"cells": pa.array([cell.tobytes()], pa.binary()), "ones": pa.array([ones.tobytes()], pa.binary())})

    return run


def _phrases(words: int, marks, bits: int):
    """Marked phrases with their counts; the null phrase has the number of all words."""
    names, kinds = ["lang", "m", "phrase", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def use(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, 0, None, shard.words), kinds, strict=True)], names=names)
        ids = shard.ids()
        room = rooms(ids, hashes(shard, lang, ids), marks.value, LONGEST, bits)
        sa, lcp = suffixes(ids, np.flatnonzero(room), LONGEST)
        spelled = pa.array(list(shard.number), pa.binary()).cast(pa.string())
        for m in range(1, LONGEST + 1):
            place, n = intervals(sa, lcp, room, m)
            for k in range(0, len(place), 1 << 16):
                at = place[k : k + (1 << 16)]
                phrase = pc.binary_join_element_wise(*(spelled.take(pa.array(ids[at + t])) for t in range(m)), " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([m] * len(at), pa.int32()), phrase, pa.array(n[k : k + (1 << 16)], pa.int64())], names=names)

    return lambda batches: _shards(batches, words, use)


def _marked(marks: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    bit = hashed & np.uint64((1 << bits) - 1)
    return (marks[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_map(numbers: DataFrame, least: int, bits: int) -> np.ndarray:
    """The lowest ``bits`` (6 to 40) of the frequent hashes as a map of 64-bit cells; the cells that have marks come to the driver, at most
    ``1 << bits`` bits and their numbers."""
    group = F.shiftright("part", max(_layout(bits, least)[0] - GROUP, 0))
    got = numbers.groupBy(group).applyInArrow(_stretches(least, bits), "cells binary, ones binary").toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    for cells, ones in zip(got["cells"], got["ones"], strict=True):
        marks[np.frombuffer(cells.as_py(), np.uint64)] = np.frombuffer(ones.as_py(), np.uint64)
    return marks


def frequent_phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", words: int = 1 << 19, bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(lang, m, phrase, f) of all phrases of up to four words with ``least`` occurrences, staged; (lang, n) with all words."""
    rows = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found, marks = np.zeros(1 << (bits - 6), np.uint64), None
    for known in range(0, LONGEST, 2):
        found = found | bit_map(rows.mapInArrow(_sieve(words, marks, known, least, bits), "part int, numbers binary"), least, bits)
        marks = broadcast_bounded(docs.sparkSession, found, "the bit map", (1 << bits) // 8 + 4096)
    counted = rows.mapInArrow(_phrases(words, marks, bits), "lang string, m int, phrase string, n long").groupBy("lang", "m", "phrase").agg(F.sum("n").alias("f"))
    table = staged(counted.where((F.col("f") >= least) | (F.col("m") == 0)), "phrases")
    return table.where("m > 0"), table.where("m = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang", words: int = 1 << 19, bits: int = 27, parts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A phrase that a longer one contains goes if the longer one has ``covered`` per cent of its occurrences or more.
    """
    table, totals = frequent_phrases(docs, least, text_col, lang_col, words, bits)
    split = lambda c: F.split(c, " ", -1)
    wide = lambda c, d: c.cast(f"decimal({d},0)")
    many = table.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), split("phrase").alias("of"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("m") - size + 1), lambda at: F.array_join(F.slice("of", at, size), " ")))))
    longer = many.where("m > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = many.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))

    cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"), "of").select("lang", "phrase", "a", "k", F.array_join(F.slice("of", F.lit(1), F.col("k")), " ").alias("first"))
    side = lambda key, value: table.select("lang", F.col("phrase").alias(key), F.col("f").alias(value))
    rest = F.expr("substring(phrase, length(first) + 2)")
    joined = cuts.join(side("first", "l"), ["lang", "first"]).select("lang", "phrase", "a", "k", "l", rest.alias("rest")).join(side("rest", "r"), ["lang", "rest"])
    score = F.call_function("div", wide(F.lit(2_000_000), 7) * wide(F.col("a"), 20), wide(F.col("l"), 19) + wide(F.col("r"), 19)).cast("long")
    scored = joined.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # Spark cuts ranks in each task only up to its threshold of 1000, so a first ranking in parts of a language bounds what one task gets
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    ahead = flat.withColumn("rank", best("lang", "part")).where(F.col("rank") <= top).drop("rank", "part")
    ranked = ahead.withColumn("rank", best("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
