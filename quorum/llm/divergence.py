"""Source divergence audit: how far the vocabularies of the sources of a language lie apart, exactly.

Terms are runs of letters: a lookup table over the concatenated UTF-8 bytes of a shard of texts finds their boundaries (every byte of a
character beyond ASCII counts as a letter) and lowers A-Z in one step. xxhash groups the slices; each slice is then compared
byte by byte with the first of its group, and slices that differ from it get groups of their own. A shard's counts by
language, source and term, with the number of its documents, are summed by Spark; a language keeps the terms of ``least``
documents.

Shares have five added to each count and are whole billionths plus one, by exact division of decimals. The divergence of two sources sums
|p - q| over all kept terms. It is computed by shards of terms as sparse rows of sources (CSR): only terms that one of the two has
are visited, as what they add beyond the difference of the two shares of absent terms, by ``reduceat`` over the rows; that difference
times the number of terms is added at the end.

Scale: one pass over the texts; shuffled are a shard's distinct terms by source, then distinct terms by source. A shard of terms holds a
bounded number of entries, so that a hot language is many shards; ``tile`` sources at a time are compared with those that follow, so a
task's result is bounded as well. Work grows with entries times sources, as exact sums for all pairs must. Ranks within a source are
over the other sources of its language; those of terms are cut to ``top`` in each task first.

Cases: null text, language and source are ''; a group without terms (or a language that keeps none) has shares of absent terms only (and
divergences of 0); repeated rows are documents of their own; ties go by the item's bytes; an empty table gives no rows; other columns
are ignored, whatever their names; a text is held whole by one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, staged

#: For each byte its lower form if it belongs to a term, else 0.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)

BILLION, ADDED = 1_000_000_000, 5
_COUNTS = "lang string, source string, term string, n long, docs long"


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes, and begin and end of each term; texts lie between the offsets, and no term crosses one."""
    low = LETTERS[data]
    inside = low != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    return low, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _same_bytes(low: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Whether the slices of these sizes at a and at b are equal."""
    equal = np.ones(len(a), bool)
    for k in range(0, len(a), step):
        n = sizes[k : k + step]
        begins = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begins, n)
        differ = low[np.repeat(a[k : k + step], n) + inner] != low[np.repeat(b[k : k + step], n) + inner]
        equal[k : k + step] = ~np.logical_or.reduceat(differ, begins) if len(n) else True
    return equal


def group_slices(low: np.ndarray, begins: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms; by hash, then verified by bytes."""
    import xxhash

    digest, raw = digest or xxhash.xxh3_64_intdigest, low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, len(begins))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [raw[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
    sizes, rep = ends - begins, first[code]
    wrong = sizes != sizes[rep]
    wrong[~wrong] = ~_same_bytes(low, begins[~wrong], begins[rep[~wrong]], sizes[~wrong])
    more: dict[bytes, int] = {}
    for k in np.flatnonzero(wrong).tolist():  # slices that share a hash with another term
        code[k] = more.setdefault(raw[begins[k] : ends[k]], len(terms) + len(more))
    return code, terms + list(more)


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """For each group and term that occur: group, term's number; the terms; occurrences and documents."""
    whole = texts.cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    buffer = whole.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low, begins, ends = term_slices(data, offsets)
    code, terms = group_slices(low, begins, ends)
    if not terms:
        return np.zeros(0, int), np.zeros(0, int), [], np.zeros(0, int), np.zeros(0, int)
    row = np.searchsorted(offsets, begins, side="right") - 1
    pairs, n = np.unique(row * len(terms) + code, return_counts=True)
    cell = group[pairs // len(terms)] * len(terms) + pairs % len(terms)
    order = np.argsort(cell, kind="stable")
    cell, at = np.unique(cell[order], return_index=True)
    docs = np.diff(np.append(at, len(order)))
    return cell // len(terms), cell % len(terms), terms, np.add.reduceat(n[order], at), docs


def _count(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    def emptied() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys: dict[tuple[str, str], int] = {}
        group = np.array([keys.setdefault(x, len(keys)) for x in zip(table["lang"].to_pylist(), table["source"].to_pylist(), strict=True)])
        g, t, terms, n, docs = shard_counts(pa.concat_arrays(table["text"].chunks), group)
        langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        names = pa.array(terms, pa.binary()).cast(pa.string())
        for k in range(0, len(g), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(g[part])), sources.take(pa.array(g[part])), names.take(pa.array(t[part])), pa.array(n[part], pa.int64()), pa.array(docs[part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held, room = [], size
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            some = batch.slice(k, 64)
            room -= some.column("text").nbytes
            held.append(some)
            if room < 0:
                yield from emptied()
                held, room = [], size
    yield from emptied()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly; null for no kept terms."""
    wide = lambda c, d: c.cast(f"decimal({d},0)")
    over = wide(F.lit(BILLION), 10) * wide(n + ADDED, 20)
    under = wide(total, 20) + wide(F.lit(ADDED), 1) * wide(kept, 18)
    return F.when(kept > 0, F.lit(1) + F.call_function("div", over, under)).cast("long")


def excess(first: int, absent: np.ndarray, tile: int, code: np.ndarray, source: np.ndarray, share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source of a tile: what its terms and those of each later source add to |absent - absent'| each, summed.

    ``absent`` has the share of an absent term for the sources from ``first`` on; the entries are (term, source, share).
    """
    order = np.lexsort((code, source))
    code, source, share = code[order], source[order] - first, share[order]
    starts = np.searchsorted(source, np.arange(len(absent) + 1))
    dense, has = np.zeros(int(code.max(initial=-1)) + 1, np.int64), np.zeros(int(code.max(initial=-1)) + 1, bool)
    for a in range(min(tile, len(absent) - 1)):
        own, base = slice(starts[a], starts[a + 1]), absent[a]
        dense[:], has[:] = base, False
        dense[code[own]], has[code[own]] = share[own], True
        later = slice(starts[a + 1], None)
        x, p, q = dense[code[later]], share[later], absent[source[later]]
        apart = np.abs(base - q)
        # a term of the later source; where this one has it too, take back what the last sum counts for it
        entries = np.abs(x - p) - apart - np.where(has[code[later]], np.abs(x - q) - apart, 0)
        sums = np.zeros(len(absent) - a - 1, np.int64)
        at = starts[a + 1 : -1] - starts[a + 1]
        some = np.flatnonzero(np.diff(starts[a + 1 :]))
        if len(some):
            sums[some] = np.add.reduceat(entries, at[some])
        mine = np.sort(share[own])
        below = np.concatenate([[0], np.cumsum(mine)])
        rest = absent[a + 1 :]
        k = np.searchsorted(mine, rest)
        # the terms of this source against the share of an absent one in each later source
        sums += rest * k - below[k] + (below[-1] - below[k]) - rest * (len(mine) - k) - len(mine) * np.abs(base - rest)
        yield first + a, sums


def _compare(tile: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, first = key[0].as_py(), key[2].as_py() * tile
        is_source = table["term"].is_null()
        heads, entries = table.filter(is_source), table.filter(table["term"].is_valid())
        place = heads["at"].to_numpy() - first
        absent = np.zeros(len(place), np.int64)
        absent[place] = heads["share"].fill_null(0).to_numpy()
        code = entries["term"].combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for a, sums in excess(first, absent, tile, code, entries["at"].to_numpy(), entries["share"].to_numpy()):
            for c, values in zip(columns, (np.full(len(sums), a), np.arange(a + 1, a + 1 + len(sums)), sums), strict=True):
                c.append(values)
        a, b, value = (pa.array(np.concatenate(c), pa.int64()) for c in columns)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "value": value})

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50, entries: int = 1 << 16, tile: int = 256) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of all pairs of sources, and each source's terms above the language's share."""
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    counted = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = counted.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("all"), F.min("source").over(of_term).alias("one"))
    kept = staged(summed.where(F.col("docs") >= least).select("lang", "source", "term", "n", "all", (F.col("one") == F.col("source")).alias("one")), "kept-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"), F.sum(F.col("one").cast("long")).alias("kept"))
    listed = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "entries", "kept"])
    of_lang = Window.partitionBy("lang")
    # a shard's result has a row for each pair of sources: it shall have as many entries, as far as they fit
    own = F.least(F.greatest(F.lit(entries), F.pow(F.count(F.lit(1)).over(of_lang), 2)), F.greatest(F.lit(entries), F.lit(1 << 22)))
    parts = F.greatest(F.ceil(F.sum("entries").over(of_lang) / own), F.lit(1)).cast("int")
    groups = listed.select("lang", "source", "total", F.sum("kept").over(of_lang).alias("kept"), F.sum("total").over(of_lang).alias("lang_total"), parts.alias("parts"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("at"))
    groups = staged(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("kept"))), "term-groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("share", share(F.col("n"), F.col("total"), F.col("kept")))
    above = shares.withColumn("value", F.col("share") - share(F.col("all"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    tiles = F.explode(F.sequence(F.lit(0), F.floor(F.col("at") / tile).cast("int"))).alias("tile")
    sparse = shares.select("lang", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("shard"), "term", "at", "share", tiles)
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), F.lit(None).cast("string").alias("term"), "at", F.col("absent").alias("share"), "kept").select("lang", "shard", "term", "at", "share", tiles)
    compared = sparse.unionByName(heads).groupBy("lang", "shard", "tile").applyInArrow(_compare(tile), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = lambda x, y: groups.select("lang", F.col("at").cast("long").alias(x), F.col("source").alias(y), F.col("absent").alias(f"{y}_absent"), *(["kept"] if x == "a" else []))
    named = compared.join(side("a", "left"), ["lang", "a"]).join(side("b", "right"), ["lang", "b"])
    base = F.coalesce(F.abs(F.col("left_absent") - F.col("right_absent")), F.lit(0)) * F.col("kept")
    both = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("of")
    pairs = named.select("lang", (F.col("value") + base).alias("value"), both).select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms.select(pairs.columns))
