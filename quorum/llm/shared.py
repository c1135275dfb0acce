"""What several operators of this package need: shared storage, Arrow batches and word splitting."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the complement of ``[^\x20\x09-\x0D]``. ``bytes.split()`` splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Where each staged table that is still referred to lies.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
#: The tables made in each ``scratch`` that this thread (or other context) has open; no other context sees or removes them.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open_scratches", default=())
#: Lets Spark delete the shuffle files of a query when it ends; what is staged needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each session how many writes hold the setting, and what it was before the first.
_HELD: WeakKeyDictionary = WeakKeyDictionary()
_LOCK = threading.Lock()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Hold the setting while at least one write of the session runs; the last puts back what was there."""
    with _LOCK:
        writers, before = _HELD.get(spark, (0, spark.conf.get(_CLEANUP, "false")))
        _HELD[spark] = writers + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _HELD.pop(spark)
            if writers > 1:
                _HELD[spark] = writers - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (as in tests) gets
    a folder of our own; on a cluster that is an error, as each executor would write to its own disk."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quorum-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    It cuts the lineage, so that a lost executor costs no recomputation, and makes the rows that several
    later branches read one and the same. The table stays until ``release`` or the ``scratch`` around it removes it.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/quorum-{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        frame.write.parquet(path)
    made = spark.read.schema(frame.schema).parquet(path)
    _PATHS[made] = path
    if _OPEN.get():
        _OPEN.get()[-1].append(made)
    return made


def release(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; other frames are left alone."""
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path is not None:
            at = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside, in the same thread, are removed at the end, but those that the body hands on."""
    own: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        release(*own)


def hand_on(frame: DataFrame) -> DataFrame:
    """Keep a staged table beyond the innermost ``scratch``, for the one around it."""
    *around, own = _OPEN.get()
    own.remove(frame)
    if around:
        around[-1].append(frame)
    return frame


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores at its end until no taken one (or earlier one) equals it."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows and bytes of a text column, so that what a slice expands to stays bounded."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for k, n in enumerate(lengths):
            if k > begin and (k - begin >= rows or held + n > size):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if len(lengths) > begin:
            yield batch.slice(begin)


def broadcast_bounded(spark: SparkSession, value: object, what: str, limit: int = 64 << 20):
    """Broadcast a fitted model after checking its pickled size: it must not grow with the data."""
    import pickle

    size = len(pickle.dumps(value, protocol=5))
    if size > limit:
        raise ValueError(f"{what} has {size} bytes; at most {limit} are broadcast")
    return spark.sparkContext.broadcast(value)
