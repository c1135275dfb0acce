"""Quality rules: a base rule, then gradient-boosted trees over statistics of the document.

The trees are grown with histograms and monotonic constraints: more symbols, repetition, duplicated lines, capitals or
one-word runs can never raise a score. A fitted forest is flattened into node arrays (feature, threshold, left,
right, value), which numpy walks for all rows of a batch and all trees at once.

Training uses a bounded sample of labelled rows (``sample`` documents, those with the smallest hashes of their ids, one row each), so
the driver's work does not depend on the size of the corpus. Scoring is one narrow pass without a shuffle.

Cases: a null or blank text has no words and fails the base rule; very long texts are read whole, in linear space;
without usable labels of both kinds the base rule decides alone; rows with repeated or null ids are each returned; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast_bounded, col, fresh, slices

SPACE = bytes([0x20, *range(0x09, 0x0E)])
INNER = bytes(range(0x80, 0xC0))  # the bytes of a code point after its first
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeated", "upper", "distinct", "runs", "marks", "digits", "line_words")
#: The direction in which a feature may move the score: -1 never up, 0 free.
MONOTONE = (0, 0, -1, -1, -1, -1, 0, -1, -1, 0, 0)


def _without(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more.

    Windows get exact ranks by doubling: pairs of words, then pairs of pairs, then pairs of those.
    """
    if len(ids) <= width:
        return 0
    ranks, step = ids, 1
    while step < width:
        key = ranks[:-step].astype(np.int64) * (int(ranks.max()) + 1) + ranks[step:]
        ranks, step = np.unique(key, return_inverse=True)[1], step * 2
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base numbers (words, their characters, symbols, duplicated lines, repeated words) and the features."""
    words = text.split()
    n = len(words)
    size = _without(text, INNER)
    chars = _without(text, INNER + SPACE)
    symbols = len(text) - _without(text, SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = repeated_words(ids)
    upper, lower = len(text) - _without(text, UPPER), len(text) - _without(text, LOWER)
    runs = int((ids[1:] == ids[:-1]).sum()) if n else 0
    marks = text.count(b"!") + text.count(b"?") + text.count(b"|")
    m = max(n, 1)
    features = (np.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), repeated / m, upper / max(upper + lower, 1), len(known) / m, runs / m, marks / m, (len(text) - _without(text, DIGITS)) / max(size, 1), n / max(len(lines), 1))
    return (n, chars, symbols, dup, repeated), features


@dataclass
class Forest:
    """Trees as node arrays of shape (trees, nodes). A leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.value))[None, :]
        at = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            go = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(go, self.left[trees, at], self.right[trees, at])
        return 1 / (1 + np.exp(-(self.prior + self.value[trees, at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Boosted trees for the logistic loss. Every split respects the constraints, and its children keep within the
    bounds that the splits above leave, so the whole forest is monotonic in each constrained feature.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    margin, nodes = np.full(n, prior), 2 ** (depth + 1) - 1
    forest = Forest(np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes)), prior, depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        best = lambda gs, hs, lo, hi: np.clip(gs / (hs + l2), lo, hi)
        work = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while work:
            node, rows, lo, hi, level = work.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(best(total_g, total_h, lo, hi))
            forest.value[t, node] = rate * own
            gain_of = lambda gs, hs, v: v * gs - 0.5 * v * v * (hs + l2)
            choice, most = None, 1e-6
            if level < depth:
                for f in range(width):
                    cuts = len(edges[f])
                    if not cuts:
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], cuts + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], cuts + 1))[:-1]
                    a, b = best(gs, hs, lo, hi), best(total_g - gs, total_h - hs, lo, hi)
                    gain = gain_of(gs, hs, a) + gain_of(total_g - gs, total_h - hs, b) - gain_of(total_g, total_h, own)
                    bad = (hs < least) | (total_h - hs < least) | (monotone[f] * (b - a) < 0)
                    gain[bad] = -1
                    k = int(gain.argmax())
                    if gain[k] > most:
                        most, choice = gain[k], (f, k, float(a[k]), float(b[k]))
            if choice is None:
                margin[rows] += rate * own
                continue
            f, k, a, b = choice
            forest.feature[t, node], forest.threshold[t, node] = f, edges[f][k]
            forest.left[t, node], forest.right[t, node] = 2 * node + 1, 2 * node + 2
            mid, go = (a + b) / 2, binned[rows, f] <= k
            low, high = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
            work += [(2 * node + 1, rows[go], *low, level + 1), (2 * node + 2, rows[~go], *high, level + 1)]
    return forest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str, where=None) -> DataFrame:
    """At most ``sample`` labelled documents, by the smallest hashes of their ids: (label, text). Of the rows of one id, the
    least text stands for all, so the bound holds for rows too."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    usable = usable if where is None else usable.where(where)
    one = usable.groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.min(label).alias("__y"))
    chosen = one.orderBy(F.xxhash64("__doc"), "__doc").limit(sample)
    texts = docs.select(col(id_col).cast("long").alias("__doc"), col(text_col).alias("text")).join(F.broadcast(chosen), "__doc")
    return texts.groupBy("__doc").agg(F.min("__y").alias("label"), F.min("text").alias("text")).drop("__doc")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Forest | None:
    """Fit the forest on a bounded sample; None when the sample lacks one of the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text"):
            got = [measure(t or b"")[1] for t in some.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("label").cast(pa.int32()), pa.array([list(map(float, x)) for x in got], pa.list_(pa.float64()))], names=["label", "x"])

    rows = labelled_sample(docs, labels, label, sample, id_col, text_col).mapInArrow(run, "label int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    y = rows.column("label").to_numpy().astype(float)
    if y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the result must not depend on the order in which rows arrive
    return fit(x[order], y[order])


def assess(docs: DataFrame, forest: Forest | None, threshold: float = 0.5, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row.

    With ``keep``, the named columns of ``docs`` come first instead of doc_id, and a result whose name one of them has
    gets underscores at its end.
    """
    model = broadcast_bounded(docs.sparkSession, forest, "the forest")
    carried = [col(c) for c in keep] if keep is not None else [col(id_col).cast("long")]
    front = keep if keep is not None else ["doc_id"]
    names = fresh(front, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(carried)), col(text_col).alias("text"))
    plain = [*rows.columns[:-1], *(f"r{k}" for k in range(len(names)))]  # Spark's Arrow functions take no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for some in slices(batches, "text"):
            got = [measure(t or b"") for t in some.column("text").cast(pa.binary()).to_pylist()]
            base = np.array([b for b, _ in got], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            score = trees.score(np.array([x for _, x in got])) if trees is not None and got else np.ones(len(got))
            columns = [pa.array(base[:, k]) for k in range(5)] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], *columns], names=plain)

    schema = T.StructType(rows.schema.fields[:-1])
    for name, kind in zip(plain[len(front) :], ["long"] * 5 + ["boolean", "double", "boolean"], strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).toDF(*front, *names)


def passing(docs: DataFrame, forest: Forest | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the trees keep, with the columns of ``docs``."""
    judged = assess(docs, forest, threshold, docs.columns, id_col, text_col)
    return judged.where(col(judged.columns[-1])).select(*(col(c) for c in docs.columns))
