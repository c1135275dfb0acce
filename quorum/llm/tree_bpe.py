"""BPE with word ends: encoding by tree concatenation, and decoding.

The vocabulary's normaliser and pattern drop white space, so a text is a row of units between ASCII white space, each of which is
encoded by itself (checked when the vocabulary is read; where that isn't so, whole texts go to the library). A text of up to
``chunk`` code points is encoded where it is read. A longer one is cut into parts of whole units, which are dealt out. A long unit
is normalised and split into words; a word longer than ``leaf`` is unsplit text: its leaves are encoded in parallel, only the last of them
with the word end, and joined pairwise, level by level.

A join encodes anew a window around the seam: one token on each side, and twice as many on a side whose outermost token doesn't come
out as it was. Once both do (or a side is used up), the result is exact: merges go by rank and then from the left, whatever lies
around, so a row of tokens is an encoding if and only if each two neighbours are the encoding of their own text; those inside the
window are, and those outside it, and at its edges, are as they were in a half.

Scale: nearly all texts never leave the task that read them. Of the others, parts and leaves are dealt out by number; a level of
joins halves the leaves, so it takes log2(longest word / leaf) shuffles of their ids. Units that come again are encoded once in a
worker (bounded memory). The ids of one text are joined in one row, which is what the result is.

Cases: a null text is empty; an empty text has no ids and decodes to the empty text; rows with repeated or null ids are kept one for
one; an empty table gives no rows; other columns are ignored, whatever their names. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import col, fresh, slices, staged

#: Kinds of rows that parts become: whole units for the library, split words, and a leaf of a long word.
UNITS, WORDS, LEAF = 0, 1, 2
_PART = "row_key long, doc_id long, part long, leaf long, leaves long, kind int, text string"
_CODED = "row_key long, doc_id long, part long, leaf long, leaves long, ids binary"


def _independent(config: dict) -> bool:
    """Whether white space only separates: the units on both sides never see each other."""
    steps = lambda x: [] if x is None else x.get("normalizers") or x.get("pretokenizers") or [x]
    model, normal, first = config["model"], steps(config["normalizer"]), steps(config["pre_tokenizer"])[:1]
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normal)
    drops = bool(first) and first[0]["type"] == "Split" and first[0]["behavior"] == "Removed" and first[0]["invert"]
    added = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in config["added_tokens"])
    return model["type"] == "BPE" and not model.get("dropout") and config.get("post_processor") is None and plain and drops and added


class WordEncoder:
    """The library's encoder with a memory of units, and the joins of the tree."""

    def __init__(self, path: str, units: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.units, self.memory, self.cuts = units, {}, _independent(config)
        probe = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str("a b\tc\nd\re\x0bf\x0cg")] if self.whole.pre_tokenizer else []
        self.cuts = self.cuts and probe == list("abcdefg")
        if not self.cuts:
            return
        model = config["model"]
        self.suffix, self.outer = model.get("end_of_word_suffix") or "", self.whole.model
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.token = {i: t for t, i in model["vocab"].items()}
        added = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.cuts:
            return self._ids(texts)
        rows = [t.encode().split() for t in texts]  # bytes split at ASCII white space alone
        wanted = set().union(*rows)
        if len(self.memory) > self.units:
            self.memory.clear()
        missed = [u for u in wanted if u not in self.memory]
        now = dict(zip(missed, self._ids([u.decode() for u in missed]), strict=True))
        long = {u: ids for u, ids in now.items() if len(u) > 64}
        self.memory.update(now)
        found = [b"".join(map(self.memory.__getitem__, r)) for r in rows]
        for u in long:
            del self.memory[u]
        return found

    def words(self, unit: str) -> Iterator[tuple[int, str]]:
        """A unit as added tokens (UNITS) and words in the alphabet of the model (WORDS), in order."""
        for k, part in enumerate(self.added.split(unit) if self.added else [unit]):
            if k % 2:
                yield UNITS, part
            elif part:
                normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                yield from ((WORDS, w) for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal))

    def piece(self, text: str, last: bool) -> list[int]:
        """The ids of a stretch of one word; ``last`` if the word ends with it."""
        return [t.id for t in (self.outer if last else self.inner).tokenize(text)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbouring stretches of one word, from their own encodings."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            ends = last and b == len(right)
            text = "".join(self.token[i] for i in (*left[len(left) - a :], *right[:b]))
            got = self.piece(text.removesuffix(self.suffix) if ends else text, ends)
            fits = a == len(left) or got[0] == left[-a]
            meets = b == len(right) or got[-1] == right[b - 1]
            if fits and meets:
                return left[: len(left) - a] + got + right[b:]
            a, b = a if fits else 2 * a, b if meets else 2 * b

    def tree(self, word: str, leaf: int) -> list[int]:
        """A word by its leaves and their joins in this process: what the tables do, for tests."""
        level = [self.piece(word[k : k + leaf], k + leaf >= len(word)) for k in range(0, len(word), leaf)]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1], k + 2 >= len(level)) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    return WordEncoder(path)


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for some in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(encoder.encode(some.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return run


def parts(encoder: WordEncoder, text: str, size: int, leaf: int) -> Iterator[tuple[int, int, int, int, str]]:
    """A long text as (part, leaf, leaves, kind, text): bounded parts of units or words, and the leaves of long words."""
    if not encoder.cuts:
        yield 0, 0, 1, UNITS, text
        return
    part, kind, held, room = 0, UNITS, [], size

    def emptied() -> Iterator[tuple[int, int, int, int, str]]:
        nonlocal part, held, room
        if held:
            yield part, 0, 1, kind, " ".join(held)
            part, held, room = part + 1, [], size

    def add(what: int, item: str) -> Iterator[tuple[int, int, int, int, str]]:
        nonlocal kind, room
        if what != kind or len(item) > room:
            yield from emptied()
            kind = what
        held.append(item)
        room -= len(item) + 1

    for unit in re.split("[\t-\r ]+", text):
        if len(unit) <= leaf:
            if unit:
                yield from add(UNITS, unit)
            continue
        for what, word in encoder.words(unit):
            if what == UNITS or len(word) <= leaf:
                yield from add(what, word)
                continue
            yield from emptied()
            n = -(-len(word) // leaf)
            yield from ((part, k, n, LEAF, word[k * leaf : (k + 1) * leaf]) for k in range(n))
            part += 1
    yield from emptied()


def _cut(path: str, size: int, leaf: int):
    names = [x.split()[0] for x in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = word_encoder(path), []
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.string()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for some in slices(batches, "text", 1):
            key, doc, text = (some.column(c)[0].as_py() for c in ("row_key", "doc_id", "text"))
            for row in parts(encoder, text, size, leaf):
                held.append((key, doc, *row))
                if len(held) == 256:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return run


def _code(path: str):
    names = [x.split()[0] for x in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for some in slices(batches, "text"):
            out = []
            for kind, text, k, n in zip(*(some.column(c).to_pylist() for c in ("kind", "text", "leaf", "leaves")), strict=True):
                if kind == UNITS:
                    out += encoder.encode([text])
                else:
                    stretches = text.split(" ") if kind == WORDS else [text]  # the model's alphabet has no white space
                    out.append(b"".join(np.array(encoder.piece(s, kind == WORDS or k + 1 == n), dtype="<u4").tobytes() for s in stretches))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:-1]), pa.array(out, pa.binary())], names=names)

    return run


def _joined(path: str):
    """One or two neighbours of a level become one node of the next."""
    names = [x.split()[0] for x in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                some, out = batch.slice(begin, 64), []
                for k, n, both in zip(*(some.column(c).to_pylist() for c in ("leaf", "leaves", "both")), strict=True):
                    sides = [np.frombuffer(x["ids"], dtype="<u4").tolist() for x in both]
                    out.append(both[0]["ids"] if len(sides) == 1 else np.array(encoder.join(*sides, k + 1 == n), dtype="<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:-1]), pa.array(out, pa.binary())], names=names)

    return run


def _end_to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            some = batch.slice(k, 1)
            ids = b"".join(x["ids"] for x in some.column("of")[0].as_py())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([ids], pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, leaf: int = 1 << 12) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit numbers) of every row; ``vocabulary`` is a tokenizers file."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_short(vocabulary), "doc_id long, ids binary")

    long = rows.withColumn("row_key", F.monotonically_increasing_id()).where(F.length("text") > chunk)
    cut = staged(long.mapInArrow(_cut(vocabulary, chunk // 4, leaf), _PART), "word-parts")
    coded = cut.repartition("row_key", "part", "leaf").mapInArrow(_code(vocabulary), _CODED)
    most = cut.agg(F.max("leaves")).first()[0] or 1
    whole, tree = coded.where("leaves = 1"), coded.where("leaves > 1")
    if most > 1:
        while most > 1:
            node = tree.groupBy("row_key", "doc_id", "part", F.floor(F.col("leaf") / 2).alias("at"), F.ceil(F.col("leaves") / 2).alias("of"))
            pairs = node.agg(F.array_sort(F.collect_list(F.struct("leaf", "ids"))).alias("both"))
            tree = pairs.withColumnsRenamed({"at": "leaf", "of": "leaves"}).mapInArrow(_joined(vocabulary), _CODED)
            most = -(-most // 2)
        whole = whole.unionByName(tree)
    ends = whole.groupBy("row_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("of"))
    # a long text of nothing but white space has no parts
    blank = long.select("row_key", "doc_id").join(ends.select("row_key"), "row_key", "left_anti").select("doc_id", F.lit(b"").alias("ids"))
    return short.unionByName(ends.mapInArrow(_end_to_end, "doc_id long, ids binary")).unionByName(blank)


def decode(frame: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the library decodes the ids to, special tokens included; without a decoder that is the tokens with spaces between.

    Null ids stay null. All columns stay; where one is called ``out`` already, the new one gets underscores at its end.
    """
    (out,) = fresh(frame.columns, out)
    names = frame.columns
    schema = ", ".join(f"`{c.replace('`', '``')}` {frame.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = word_encoder(vocabulary).whole
        table = {} if whole.decoder else {i: t for t, i in whole.get_vocab(with_added_tokens=True).items()}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some, texts = batch.slice(begin, 256), []
                for ids in some.column(ids_col).to_pylist():
                    if ids is None:
                        texts.append(None)
                        continue
                    ids = np.frombuffer(ids, dtype="<u4").tolist()
                    texts.append(" ".join(table[i] for i in ids if i in table) if table else whole.decode(ids, skip_special_tokens=False))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])

    return frame.mapInArrow(run, schema)
