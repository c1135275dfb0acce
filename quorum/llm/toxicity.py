"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

A text is read as units: its lower-cased words without the marks around them, runs of three or more single characters as one unit, and
long units as overlapping windows. The kernel of two units sums over common subsequences of three and of four
characters, each weighted by decay to the power of the span it takes on either side, with spans up to ``SPANS``; so a letter put into or left
out of an insult costs some of the match, not all of it. It is divided by what a unit of that length could reach.

Landmarks are units of the training sentences. With K the kernel among them, a unit's features are its kernel row
times K to the power -1/2, and the machine is linear in them (squared hinge loss, Newton steps). A label covers a document
and not a sentence, so the toxic sentences of toxic documents are found by rounds of training: at first those with the units
that toxic documents favour, then those that the machine marks; all sentences of clean documents are clean, and those
that it confuses join the training. The decision is linear in subsequences, so the landmarks fold into one table of weights, which scores
new units by lookups alone. Document scores come from a logistic curve over the strongest units.

Training reads a bounded sample (``sample`` labelled documents of at most ``longest`` characters, one row for each id), held as
numbers of units. Scoring is one narrow
pass without a shuffle, over whole texts.

Cases: a null or blank text has no units and gets the lowest score; without labels of both kinds the score is 0; rows
with repeated or null ids are each returned; very long texts are read whole; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import labelled_sample
from .shared import broadcast_bounded, col, fresh, slices

DECAY = 0.6
#: Order of the subsequences and the longest span that they may take.
SPANS = ((3, 6), (4, 7))
WINDOW, STRIDE = 24, 12
TRIM = ".,!?;:*$%&#|()[]{}\"'<>=+-_/\\~`^@"
SHAPES = [(order, (0, *rest)) for order, span in SPANS for rest in combinations(range(1, span), order - 1)]


def units(text: str) -> list[str]:
    """The units of a text with a mark for their beginning and end, in order and with repetitions."""
    found, single = [], []

    def spelled():
        if len(single) >= 3:
            found.append("".join(single))
        single.clear()

    for word in text.lower().split():
        w = word.strip(TRIM)
        if len(w) == 1:
            single.append(w)
            continue
        if w:
            spelled()
            found.append(w)
    spelled()
    out = []
    for w in found:
        if len(w) <= WINDOW:
            out.append(f"\x02{w}\x03")
        else:
            w = f"\x02{w}\x03"
            out += [w[k : k + WINDOW] for k in range(0, len(w) - STRIDE, STRIDE)]
    return out


def sentences(text: str) -> list[list[str]]:
    """The units of each sentence (ended by a line feed or a full stop)."""
    return [u for s in text.replace(".", ".\n").split("\n") if (u := units(s))]


def _reach(length: int) -> float:
    """The norm of a unit of this length all of whose subsequences differ: what its kernel is divided by."""
    return float(np.sqrt(sum(DECAY ** (2 * (s[-1] + 1)) * max(length - s[-1], 0) for _, s in SHAPES))) or 1.0


REACH = np.array([_reach(n) for n in range(WINDOW + 4)])


class Reader:
    """Turns units into the codes of their subsequences, over the characters of the landmarks; others match nothing in any."""

    def __init__(self, alphabet: str):
        self.alphabet, self.codes, self.base = alphabet, {c: k + 1 for k, c in enumerate(alphabet)}, len(alphabet) + 1

    def subsequences(self, some: list[str]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
        """For each shape: its order, its weight, the units' numbers and the keys of subsequences within the alphabet."""
        get = self.codes.get
        c = np.array([get(x, 0) for u in some for x in u], np.int64)
        own = np.repeat(np.arange(len(some)), [len(u) for u in some])
        for order, shape in SHAPES:
            n = len(c) - shape[-1]
            if n <= 0:
                continue
            key, good = np.zeros(n, np.int64), own[:n] == own[shape[-1] :]
            for d in shape:
                key = key * self.base + c[d : d + n]
                good &= c[d : d + n] > 0
            yield order, DECAY ** (shape[-1] + 1), own[:n][good], key[good]


class Keys:
    """Sorted keys, found by bisection; a table of bits by hash first passes over most that are not among them."""

    def __init__(self, keys: np.ndarray):
        self.sorted, self.shift = keys, np.uint64(64 - max(8, int(8 * len(keys)).bit_length()))
        self.bits = np.zeros(1 << int(64 - self.shift), bool)
        self.bits[self._slot(keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some keys are here, and where."""
        maybe = np.flatnonzero(self.bits[self._slot(keys)])
        at = np.searchsorted(self.sorted, keys[maybe])
        hit = self.sorted[np.minimum(at, len(self.sorted) - 1)] == keys[maybe] if len(self.sorted) else np.zeros(0, bool)
        return maybe[hit], at[hit]


@dataclass
class Machine:
    alphabet: str
    tables: dict[int, tuple[Keys, np.ndarray]]  # by order, the subsequences and their weights
    bias: float
    curve: np.ndarray  # of the document's logistic curve

    def decide(self, some: list[str]) -> np.ndarray:
        total = np.zeros(len(some))
        for order, weight, own, key in Reader(self.alphabet).subsequences(some):
            keys, weights = self.tables[order]
            hit, at = keys.find(key)
            total += weight * np.bincount(own[hit], weights[at], len(some))
        return total / REACH[[len(u) for u in some]] + self.bias

    def score(self, decisions: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(_summary(decisions) @ self.curve, -30, 30))))


def _summary(decisions: np.ndarray) -> np.ndarray:
    """What the curve sees of a document: its strongest and second strongest unit, and how many are marked."""
    if not len(decisions):
        return np.array([1.0, -2.0, -2.0, 0.0])
    top = np.partition(decisions, -2)[-2:] if len(decisions) > 1 else np.array([-2.0, decisions[0]])
    return np.array([1.0, np.clip(top[1], -2, 2), np.clip(top[0], -2, 2), np.log1p((decisions > 0).sum())])


class _Kernel:
    """Kernel rows between units and landmarks, by lists of the landmarks that have a subsequence."""

    def __init__(self, landmarks: list[str], alphabet: str):
        self.reader, self.landmarks, self.lists = Reader(alphabet), landmarks, {}
        found = list(self.reader.subsequences(landmarks))
        reach = REACH[[len(u) for u in landmarks]]
        for order, _ in SPANS:
            own = np.concatenate([o for n, _, o, _ in found if n == order] or [np.zeros(0, np.int64)])
            key = np.concatenate([k for n, _, _, k in found if n == order] or [np.zeros(0, np.int64)])
            value = np.concatenate([np.full(len(o), w) for n, w, o, _ in found if n == order] or [np.zeros(0)]) / reach[own]
            by_key = np.argsort(key, kind="stable")
            keys, begins = np.unique(key[by_key], return_index=True)
            self.lists[order] = Keys(keys), np.r_[begins, len(key)], own[by_key], value[by_key]

    def rows(self, some: list[str], block: int = 400) -> np.ndarray:
        wide, out = len(self.landmarks), np.zeros((len(some), len(self.landmarks)), np.float32)
        for begin in range(0, len(some), block):
            part = some[begin : begin + block]
            total = np.zeros(len(part) * wide)
            for order, weight, own, key in self.reader.subsequences(part):
                keys, begins, marks, value = self.lists[order]
                hit, at = keys.find(key)
                sizes = begins[at + 1] - begins[at]
                each = np.repeat(begins[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                total += np.bincount(np.repeat(own[hit] * wide, sizes) + marks[each], weight * value[each], len(total))
            out[begin : begin + block] = total.reshape(len(part), wide) / REACH[[len(u) for u in part]][:, None]
        return out

    def folded(self, beta: np.ndarray) -> dict[int, tuple[Keys, np.ndarray]]:
        out = {}
        for order, (keys, begins, marks, value) in self.lists.items():
            which = np.repeat(np.arange(len(keys.sorted)), np.diff(begins))
            out[order] = keys, np.bincount(which, value * beta[marks], len(keys.sorted))
        return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, steps: int = 25, block: int = 2048) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    reg = np.eye(z.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(steps):
        left, right = reg.copy(), np.zeros(len(w))
        for k in range(0, len(z), block):
            part, label = z[k : k + block].astype(float), y[k : k + block]
            active = label * (part @ w) < 1
            part = part[active]
            weighed = 2 * c * part * weight[k : k + block][active, None]
            left += weighed.T @ part
            right += weighed.T @ label[active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _variants(unit: str, rng: np.random.Generator) -> list[str]:
    """An insult with inserted characters, with a letter left out and with one doubled."""
    core = unit.strip("\x02\x03")
    if len(core) < 4 or len(core) > 12:
        return []
    k, mark = int(rng.integers(1, len(core) - 1)), str(rng.choice(list(".*-_")))
    return [f"\x02{x}\x03" for x in (mark.join(core), core[:k] + mark + core[k:], core[:k] + core[k] + core[k:])]


class _Sample:
    """Labelled documents as numbers of units: a unit's text is held once, numbered in the order of the texts."""

    def __init__(self, documents: list[tuple[str, int]]):
        known: dict[str, int] = {}
        flat, ends, self.bounds, self.toxic = array("i"), array("q"), [0], np.array([bool(y) for _, y in documents])
        for text, _ in documents:
            for s in sentences(text or ""):
                flat.extend(known.setdefault(u, len(known)) for u in s)
                ends.append(len(flat))
            self.bounds.append(len(ends))
        self.units = sorted(known)
        number = np.empty(len(known), np.int32)
        number[[known[u] for u in self.units]] = np.arange(len(known))
        self.flat, self.ends = number[np.frombuffer(flat, np.int32)] if len(flat) else np.zeros(0, np.int32), np.r_[0, np.frombuffer(ends, np.int64)]

    def of(self, k: int) -> np.ndarray:
        """The units of a document."""
        return self.flat[self.ends[self.bounds[k]] : self.ends[self.bounds[k + 1]]]

    def strongest(self, k: int, score: np.ndarray) -> np.ndarray:
        """The first of the strongest units of each sentence of a document."""
        at = self.ends[self.bounds[k] : self.bounds[k + 1] + 1]
        return np.array([self.flat[a + score[self.flat[a:b]].argmax()] for a, b in zip(at, at[1:], strict=False)], np.int64)

    def holders(self, toxic: bool) -> np.ndarray:
        """How many documents of a kind have each unit."""
        counts = np.zeros(len(self.units), np.int64)
        for k in np.flatnonzero(self.toxic == toxic):
            counts[np.unique(self.of(k))] += 1
        return counts


def fit(documents: list[tuple[str, int]], landmarks: int = 400, clean: int = 8_000, rounds: int = 2, seed: int = 7) -> Machine | None:
    """Train on (text, label) pairs. None without both labels."""
    documents = sorted(documents, key=lambda d: (d[1], d[0] or ""))
    if len({y for _, y in documents}) < 2:
        return None
    rng = np.random.default_rng(seed)
    read = _Sample(documents)
    units, n_toxic, n_clean = read.units, int(read.toxic.sum()), int((~read.toxic).sum())
    in_toxic, in_clean = read.holders(True), read.holders(False)
    odds = np.where(in_toxic > 0, np.log((in_toxic + 0.2) / (n_toxic + 1)) - np.log((in_clean + 0.2) / (n_clean + 1)), -9.0)
    level, score = 1.5, odds
    known = np.flatnonzero(in_clean)
    by_count = known[np.lexsort((known, -in_clean[known]))]
    half = clean // 2
    rest = by_count[half:]
    pool = np.r_[by_count[:half], rng.choice(rest, min(half, len(rest)), replace=False) if len(rest) else rest]
    hard = np.zeros(0, np.int64)
    machine = None
    for _ in range(rounds):
        # The witness sentences: in each toxic document those whose strongest unit is marked, or else the strongest one.
        positive = np.zeros(len(units), np.int64)
        for k in np.flatnonzero(read.toxic):
            own, best = read.of(k), read.strongest(k, score)
            marked = best[score[best] > level]
            if not len(marked):
                marked = best[np.argsort(-score[best], kind="stable")[:1]]
            marked = np.unique(np.r_[marked, own[(odds[own] > 2.5) & (in_toxic[own] > 2)]])
            positive[marked[in_clean[marked] * n_toxic <= 0.25 * in_toxic[marked] * n_clean]] += 1
        chosen = np.flatnonzero(positive)
        if not len(chosen):
            return None
        chosen = chosen[np.lexsort((chosen, -positive[chosen]))]
        favoured = [units[k] for k in chosen]
        extra = [v for u in favoured[:400] for v in _variants(u, rng)]
        negative = [units[k] for k in np.union1d(pool, hard) if not positive[k]]
        marks = favoured[: landmarks // 2]
        marks += [negative[k] for k in sorted(rng.choice(len(negative), min(len(negative), landmarks - len(marks)), replace=False))]
        kernel = _Kernel(marks, "".join(sorted(set("".join(marks)))))
        values, vectors = np.linalg.eigh(kernel.rows(marks).astype(float))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        train = [*favoured, *extra, *negative]
        y = np.array([1.0] * (len(favoured) + len(extra)) + [-1.0] * len(negative))
        weight = np.r_[np.sqrt(positive[chosen]), np.full(len(extra), 0.15), np.ones(len(negative))]
        weight[y > 0] *= 0.5 * len(negative) / max(weight[y > 0].sum(), 1e-9) / 2
        z = np.hstack([kernel.rows(train) @ root.astype(np.float32), np.ones((len(train), 1), np.float32)])
        w = _svm(z, y, weight / len(train) * 50)
        machine = Machine(kernel.reader.alphabet, kernel.folded(root @ w[:-1]), float(w[-1]), np.zeros(4))
        score = np.concatenate([machine.decide(units[k : k + 10_000]) for k in range(0, len(units), 10_000)])
        level = 0.0
        confused = np.flatnonzero((in_clean > 0) & (score > -0.5) & (positive == 0))
        hard = np.union1d(hard, confused[np.lexsort((confused, -score[confused]))][:6000])
    x = np.array([_summary(score[read.of(k)]) for k in range(len(documents))])
    machine.curve = _logistic(x, read.toxic.astype(float))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 6000, id_col: str = "doc_id", text_col: str = "text", where=None) -> Machine | None:
    """Fit on a bounded sample of labelled documents; ``where`` restricts the rows of ``labels`` that may be learnt from."""
    short = docs.where(F.length(col(text_col)) <= longest)
    rows = labelled_sample(short, labels, "toxic", sample, id_col, text_col, where).toArrow()
    return fit(list(zip(rows.column("text").to_pylist(), rows.column("label").to_pylist(), strict=True))) if rows.num_rows else None


_MEMORY: dict = {}


def _decisions(machine: Machine, mark: str, texts: list[list[str]], most: int = 600_000) -> list[np.ndarray]:
    """The decisions of all units of some texts. Those already met by this worker are remembered, up to a bound."""
    if mark not in _MEMORY:
        _MEMORY.clear()
    memory = _MEMORY.setdefault(mark, {})
    if len(memory) > most:
        memory.clear()
    new = list({u for t in texts for u in t if u not in memory})
    for k in range(0, len(new), 20_000):
        memory.update(zip(new[k : k + 20_000], machine.decide(new[k : k + 20_000]).tolist(), strict=True))
    return [np.array([memory[u] for u in t]) for t in texts]


def assess(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row. With ``keep``, the named columns of ``docs`` come first instead of doc_id, and
    a result whose name one of them has gets underscores at its end."""
    model = broadcast_bounded(docs.sparkSession, machine, "the machine")
    mark = uuid.uuid4().hex
    carried = [col(c) for c in keep] if keep is not None else [col(id_col).cast("long")]
    front = keep if keep is not None else ["doc_id"]
    names = fresh(front, "score", "predicted")
    rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(carried)), col(text_col).alias("text"))
    plain = [*rows.columns[:-1], *(f"r{k}" for k in range(len(names)))]  # Spark's Arrow functions take no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for some in slices(batches, "text", rows=512, size=4 << 20):
            read = [units(t or "") for t in some.column("text").to_pylist()]
            scores = np.array([own.score(d) for d in _decisions(own, mark, read)]) if own is not None else np.zeros(len(read))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype("int32"))], names=plain)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("r0", "double").add("r1", "integer")).toDF(*front, *names)


def passing(docs: DataFrame, machine: Machine | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted as toxic, with the columns of ``docs``."""
    judged = assess(docs, machine, threshold, docs.columns, id_col, text_col)
    return judged.where(col(judged.columns[-1]) == 0).select(*(col(c) for c in docs.columns))
