"""Bounded-space online packing of token sequences into fixed windows.

Each partition encodes its documents and keeps ``open_windows`` windows open. A document's whole windows are emitted
at once; its remainder goes to the open window that it fits best. When none fits and no further window may be opened,
the fullest is topped up with the head of the remainder, which fills it, and emitted; the rest begins a new window.
So windows emitted on the way have no padding. The windows that a partition leaves open are merged by groups of
partitions in the same manner. What a group has left in its last window is cut into sequences whose lengths are powers
of two, which need no padding.

Scale: one narrow pass encodes and packs; only the leftover windows (at most ``open_windows`` a partition) are
shuffled. A merge group holds ``fan_in * open_windows`` windows at most, whatever the input. The pieces of the
first pass are staged in the shared folder, because finished and leftover pieces are read separately and must stem
from one run.

Cases: a null text is empty; an empty text is one piece with the end id alone; texts of any length are cut; repeated
rows are packed each for itself; rows with a null id are kept with that null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import col, slices, staged
from .tokens import byte_encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("leftover", pa.bool_())])


class Packer:
    """Best fit into a bounded number of open windows. ``add`` and ``rest`` return finished windows, as lists of pieces.

    A piece is [document, start, ids as bytes, tokens of the document].
    """

    def __init__(self, window: int, open_windows: int):
        self.window, self.limit, self.open, self.used = window, open_windows, [], []

    def add(self, doc, start: int, ids: bytes, total: int) -> list[list]:
        done, size, at, n = [], self.window, 0, len(ids) // 4
        while n - at >= size:
            done.append([[doc, start + at, ids[4 * at : 4 * (at + size)], total]])
            at += size
        while at < n:
            need = n - at
            fits = [k for k, u in enumerate(self.used) if size - u >= need]
            if fits:
                k, take = max(fits, key=lambda k: self.used[k]), need
            elif len(self.open) < self.limit:
                self.open.append([])
                self.used.append(0)
                k, take = len(self.open) - 1, need
            else:
                k = max(range(len(self.open)), key=lambda k: self.used[k])
                take = size - self.used[k]
            self.open[k].append([doc, start + at, ids[4 * at : 4 * (at + take)], total])
            self.used[k] += take
            at += take
            if self.used[k] == size:
                done.append(self.open.pop(k))
                self.used.pop(k)
        return done


def powers(pieces: list[list]) -> Iterator[list[list]]:
    """Cut the pieces of one window into sequences whose lengths are powers of two, the longest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    queue = [list(p) for p in pieces]
    while left:
        room = 1 << (left.bit_length() - 1)
        left, sequence = left - room, []
        while room:
            doc, start, ids, total = queue[0]
            take = min(room, len(ids) // 4)
            sequence.append([doc, start, ids[: 4 * take], total])
            room -= take
            if 4 * take == len(ids):
                queue.pop(0)
            else:
                queue[0] = [doc, start + take, ids[4 * take :], total]
        yield sequence


def _rows(windows: list[list[list]], first: int) -> Iterator[tuple]:
    for k, pieces in enumerate(windows):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, first + k, at
            at += len(ids) // 4


def _first_pass(path: str, pattern: str, end_id: int, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, packer, made = TaskContext.get().partitionId(), byte_encoder(path, pattern, True), Packer(window, open_windows), 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def batch(windows, leftover):
            nonlocal made
            columns = list(zip(*_rows(windows, (part << 32) + made), strict=True))
            made += len(windows)
            if columns:
                arrays = [pa.array(c, type=t) for c, t in zip(columns, ARROW.types, strict=False)]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int64()), pa.array([leftover] * n, pa.bool_())], schema=ARROW)

        for some in slices(batches, "text"):
            done = []
            for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                done += packer.add(doc, 0, ids, len(ids) // 4)
            yield from batch(done, False)
        yield from batch(packer.open, True)

    return run


def _merge(window: int, open_windows: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        packer, done = Packer(window, open_windows), []
        order = pieces.sort_values(["sequence_id", "offset"], kind="stable")
        for doc, start, ids, total in zip(order["doc_id"].astype(object).where(order["doc_id"].notna(), None), order["start"], order["ids"], order["doc_tokens"], strict=True):
            done += packer.add(doc, int(start), bytes(ids), int(total))
        last = Packer(window, 1)  # what is still open goes through one window
        for pieces_of in packer.open:
            for doc, start, ids, total in pieces_of:
                done += last.add(doc, start, ids, total)
        for rest in last.open:
            done += powers(rest)
        out = pd.DataFrame(list(_rows(done, (1 << 62) + (int(key[0]) << 32))), columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = 1024, open_windows: int = 32, fan_in: int = 64) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the JSON file of a byte-level vocabulary; an added token's string inside a text becomes that
    token, as that library does by default. ``end_id`` closes each document.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    first = texts.mapInArrow(_first_pass(tokenizer, pattern, end_id, window, open_windows), PIECES + ", part long, leftover boolean")
    pieces = staged(first, "pieces")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    merged = pieces.where("leftover").withColumn("grp", F.floor(F.col("part") / fan_in)).groupBy("grp").applyInPandas(_merge(window, open_windows), PIECES)
    return pieces.where("not leftover").select(*columns).unionByName(merged)
