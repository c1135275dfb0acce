"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text longer than ``chunk`` code points is cut into chunks that overlap. Each chunk is pre-tokenised in its own row,
wherever the row lands. The pattern looks ahead but never behind, so once the boundaries that two neighbouring chunks
find meet at one place in the overlap, they agree from there on: that place becomes a stitch. Boundaries that the end
of a chunk may have caused are not trusted, and a stitch must follow a character that is no white space, so that
the piece between two stitches has the same pre-tokens alone as in the whole text. Neighbours whose boundaries
never meet (one run of letters longer than the overlap) stay one piece. The pieces are then encoded in parallel and
their ids joined in order. Decoding concatenates the bytes of the ids.

Scale: texts of up to ``chunk`` code points, nearly all, are encoded where they are read, without a shuffle. Long ones
are dealt out by chunk, twice: before the boundaries are sought and before the pieces are encoded.

Cases: a null text is empty; an empty text has no ids and decodes to no bytes; rows with repeated or null ids are kept
one for one; an empty table gives no rows; encoding ignores other columns, decoding keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, fresh, slices
from .tokens import byte_encoder, ranks_of

#: Code points at the end of a chunk that may change a boundary: the longest contraction has three.
UNSURE = 3


def boundaries(pattern: regex.Pattern, text: str, begin: int = 0) -> list[int]:
    """The ends of the pre-tokens that follow a character that is no white space, as far as the end cannot change them."""
    return [begin + m.end() for m in pattern.finditer(text) if m.end() <= len(text) - UNSURE and not text[m.end() - 1].isspace()]


def _encode_texts(path: str, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern)
        for some in slices(batches, "text"):
            ids = [encoder.ids(t or "").astype("int32") for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return run


def _edges(pattern: str, overlap: int, chunk: int):
    """For each chunk the boundaries in the overlap with the one before (head) and with the one after (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern)
        for some in slices(batches, "text"):
            parts, texts = (some.column(c).to_pylist() for c in ("part", "text"))
            heads, tails = [], []
            for part, text in zip(parts, texts, strict=True):
                ends = boundaries(found, text, part * chunk)
                heads.append([e for e in ends if part * chunk < e <= part * chunk + overlap] if part else [])
                tails.append([e for e in ends if e > (part + 1) * chunk])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("row_key"), some.column("doc_id"), some.column("part"), some.column("text"), pa.array(heads, lists), pa.array(tails, lists)], names=["row_key", "doc_id", "part", "text", "head", "tail"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """doc_id and ids (array<int>) of every row. ``ranks`` is a rank file or the JSON form of a byte-level vocabulary."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode_texts(ranks, pattern, ["doc_id"]), "doc_id long, ids array<int>")

    long = rows.withColumn("row_key", F.monotonically_increasing_id()).where(F.length("text") > chunk)
    last = F.floor((F.length("text") - 1) / chunk)
    chunks = long.select("row_key", "doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("row_key", "doc_id", F.col("part").cast("long").alias("part"), F.substring(F.col("text"), (F.col("part") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("text"))
    edges = chunks.repartition("row_key", "part").mapInArrow(_edges(pattern, overlap, chunk), "row_key long, doc_id long, part long, text string, head array<long>, tail array<long>")
    by_row = Window.partitionBy("row_key").orderBy("part")
    stitched = (
        edges.withColumn("cut", F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_row)))))
        .withColumn("piece", F.count("cut").over(by_row))
        .withColumn("until", F.lead("cut").over(by_row))
        .withColumn("ends", F.lead("part").over(by_row).isNull())
    )
    # A chunk gives its text from its own cut (or its beginning) to the next chunk's cut (or that chunk's beginning).
    base = F.col("part") * chunk
    begin = F.coalesce("cut", base)
    end = F.when(F.col("ends"), base + chunk + overlap).otherwise(F.coalesce("until", base + chunk))
    own = F.substring(F.col("text"), (begin - base + 1).cast("int"), (end - begin).cast("int"))
    pieces = stitched.select("row_key", "doc_id", "piece", "part", own.alias("own")).groupBy("row_key", "doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("part", "own"))).alias("owns"))
    texts = pieces.select("row_key", "doc_id", F.col("piece").cast("long").alias("piece"), F.array_join(F.transform("owns", lambda x: x["own"]), "").alias("text")).repartition("row_key", "piece")
    encoded = texts.mapInArrow(_encode_texts(ranks, pattern, ["row_key", "doc_id", "piece"]), "row_key long, doc_id long, piece long, ids array<int>")
    joined = encoded.groupBy("row_key", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined.select("doc_id", "ids"))


def decode(frame: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for as ``out``, with underscores at its end where the frame has that column already. A null list
    stays null; an id outside the vocabulary raises KeyError."""
    (made,), at = fresh(frame.columns, out), frame.columns.index(ids_col)
    plain = frame.toDF(*(f"c{k}" for k in range(len(frame.columns))))  # the names that may have dots come back at the end
    schema = T.StructType([*plain.schema.fields, T.StructField("made", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in ranks_of(ranks)[0].items()}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                values = [None if not x.is_valid else b"".join(map(table.__getitem__, x.values.to_pylist())) for x in some.column(at)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(values, pa.binary())], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*frame.columns, made)


def reference_pieces(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """The same chunking on one text, for tests and small jobs without Spark."""
    found = regex.compile(pattern)
    starts = range(0, max(len(text), 1), chunk)
    ends = [boundaries(found, text[s : s + chunk + overlap], s) for s in starts]
    cuts = [0]
    for k, s in enumerate(starts[1:], 1):
        both = {e for e in ends[k - 1] if e > s} & {e for e in ends[k] if s < e <= s + overlap}
        cuts += [min(both)] if both else []
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


__all__ = ["boundaries", "decode", "encode", "reference_pieces"]
