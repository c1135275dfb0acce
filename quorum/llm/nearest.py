"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals, then exact reranking.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample of the vectors (``sample`` of them, by the
smallest hashes of their ids) and broadcast; every vector is indexed: its cell, the code of its residual and itself.
A query visits cells in the order of their centroids' inner product with it until they hold ``share`` of all vectors
(and more than ``k``), as the counts of the cells tell. In a cell, a table of the query's inner products with all code words
scores each code by additions; the best ``rerank`` distinct vectors of a block, and all that tie with the last of them, are scored
again with the original vectors in double precision, and the best ``k`` of all visited blocks are returned, ties to the smaller id.
Equal vectors are scored once and stand for their smallest ids, so a group of copies of any size loses none that belongs to the best.

Recall depends on how clustered the vectors are. For vectors without any structure (independent directions) neighbours are
spread over most cells; the default ``share`` is chosen for that case, and a smaller one serves clustered data.

Scale: the index is one narrow pass, staged in the shared folder. A cell is dealt out in blocks of about ``block`` vectors and its
visitors in blocks of about ``visitors`` queries, by hash, so that no task holds a large cell (many equal vectors) and none
all queries. What comes back for a query and a block is one row with at most ``k`` candidates. A vector is sent once for each
``visitors`` queries, a query once for each block that it visits; so with a number of queries in proportion to the vectors, as in the
registered query, work and shuffle grow with the square of the table, divided by the sizes of blocks, while a fixed number of queries
costs one reading of the index. A smaller ``share`` divides both, where the vectors have structure.

Cases: null vectors and such with null or non-finite components, zero vectors and rows without an id take no part, nor do
vectors of another than the most common length; a query whose row is repeated is searched once, while each repeated row is a
candidate (never for its own id); with fewer than ``k`` candidates all are returned; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_bounded, col, staged

RESULT = "query_id long, ids array<long>, scores array<double>"


def k_means(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest_of(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, column, len(centres)) for column in x.T], 1).astype(x.dtype)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[k : k + 4096] @ centres.T - half).argmax(1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    centres: np.ndarray  # (cells, dim)
    books: list[np.ndarray]  # for each slice of the dimensions its code words
    edges: list[int]  # where the slices begin and end

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of vectors."""
        cell = nearest_of(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest_of(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], 1).astype(np.uint8)

    def visits(self, queries: np.ndarray, counts: np.ndarray, share: float, least: int) -> list[np.ndarray]:
        """For each query the cells to visit: the nearest, until they hold enough vectors."""
        need = max(math.ceil(share * counts.sum()), least)
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        return [row[: int(np.searchsorted(h, need)) + 1] for row, h in zip(order, held, strict=True)]

    def search(self, cell: int, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The best k ids and exact scores of a block for each query; ``own`` are the ids of the queries themselves."""
        row = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, which = np.unique(row, return_index=True, return_inverse=True)
        begins, members = _smallest_ids(which.ravel(), ids, k)
        sizes = np.diff(begins)
        only, single = members[begins[:-1]], members[begins[:-1]] == members[begins[1:] - 1]  # a vector that one id has is not for that id
        codes, exact_queries, exact_vectors = codes[first], queries.astype(np.float64), vectors[first].astype(np.float64)
        queries = queries.astype(np.float32, copy=False)
        for begin in range(0, len(queries), 256):
            some = queries[begin : begin + 256]
            scores = np.repeat((some @ self.centres[cell])[:, None], len(first), 1)
            for m, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
                scores += (some[:, a:b] @ self.books[m].T)[:, codes[:, m]]
            scores[(own[begin : begin + 256][:, None] == only[None, :]) & single[None, :]] = -np.inf
            for q in range(len(some)):
                least = np.partition(scores[q], -rerank)[-rerank] if len(first) > rerank else -np.inf
                top = np.flatnonzero((scores[q] >= least) & (scores[q] > -np.inf))
                exact = (exact_vectors[top] * exact_queries[begin + q]).sum(1)
                ends = np.cumsum(sizes[top])
                near = members[np.repeat(begins[top] - ends + sizes[top], sizes[top]) + np.arange(ends[-1] if len(ends) else 0)]
                exact = np.repeat(exact, sizes[top])
                other = near != own[begin + q]
                near, exact = near[other], exact[other]
                best = np.lexsort((near, -exact))[:k]
                yield near[best], exact[best]


def _smallest_ids(which: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct vector's ids begin, and the ids: of equal vectors the smallest that can be among the k best of a query, whatever its own id."""
    order = np.lexsort((ids, which))
    which, ids = which[order], ids[order]
    place = np.arange(len(ids))

    def nth(new: np.ndarray) -> np.ndarray:
        return place[: len(new)] - np.maximum.accumulate(np.where(new, place[: len(new)], 0))

    start = np.r_[True, which[1:] != which[:-1]]
    keep = nth(start | np.r_[True, ids[1:] != ids[:-1]]) < k  # of a repeated id k rows at most
    which, ids = which[keep], ids[keep]
    keep = nth(np.r_[True, which[1:] != which[:-1]]) < 2 * k  # without a query's own id, k at least are left
    which, ids = which[keep], ids[keep]
    return np.r_[0, np.flatnonzero(which[1:] != which[:-1]) + 1, len(ids)], ids


def fit(sample: np.ndarray, cells: int, width: int = 4, words: int = 64, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centres = k_means(sample, cells, 10, rng)
    rest = sample - centres[nearest_of(sample, centres)]
    edges = [*range(0, sample.shape[1], width), sample.shape[1]]
    return Index(centres, [k_means(rest[:, a:b], words, 8, rng) for a, b in zip(edges, edges[1:], strict=False)], edges)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def neighbours(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = 0.75, rerank: int = 80, sample: int = 8192, block: int = 8192, visitors: int = 32768, most_cells: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``queries`` holds."""
    spark = rows.sparkSession
    # floats stay floats; vectors of any other numbers are kept, compared and reranked as doubles
    kind = "array<float>" if rows.select(col(vector_col)).dtypes[0][1] == "array<float>" else "array<double>"
    vectors = rows.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast(kind).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return none
    dim, n = lengths[0]["dim"], lengths[0]["n"]
    vectors = vectors.where(F.size("vector") == dim)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    cells = max(1, min(most_cells, round(math.sqrt(n) / 4)))
    index = broadcast_bounded(spark, fit(_matrix(drawn.column("vector").combine_chunks(), dim), cells), "the index")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = index.value.assign(_matrix(batch.column("vector"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("int32")), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "asked", "cell", "code"])

    table = staged(vectors.mapInArrow(assign, f"vec_id long, vector {kind}, asked boolean, cell int, code binary"), "vectors")
    counts = np.zeros(cells, np.int64)
    for r in table.groupBy("cell").count().collect():  # one row for each cell, most_cells at most
        counts[r["cell"]] = r["count"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                got = index.value.visits(_matrix(some.column("query"), dim), counts, share, k + 1)
                yield pa.RecordBatch.from_arrays([some.column("query_id"), some.column("query"), pa.array(got, pa.list_(pa.int32()))], names=["query_id", "query", "cells"])

    asked = table.where("asked").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates(["query_id"])
    visits = asked.mapInArrow(visit, f"query_id long, query {kind}, cells array<int>")
    blocks = np.maximum(1, -(-counts // block))
    n_asked = table.where("asked").count()
    parts = max(1, -(-n_asked // visitors))
    sizes = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "cell int, blocks int")
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    probes = visits.select("query_id", "query", part, F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").select("query_id", "query", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = table.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "vector", "code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []}, dtype=object)
        own = left["query_id"].to_numpy()
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        found = index.value.search(int(key[0]), np.stack(left["query"]), own, right["vec_id"].to_numpy(), codes, np.stack(right["vector"]), k, rerank)
        ids, scores = zip(*found, strict=True)
        return pd.DataFrame({"query_id": own, "ids": list(ids), "scores": list(scores)})

    key = ["cell", "block", "part"]
    found = probes.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(search, RESULT)
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("less"), p["ids"].alias("id")))
    best = found.where(F.size("ids") > 0).select("query_id", pairs.alias("pairs")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "p")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.less")).alias("score"))
