"""Members of remote zip archives by byte ranges: a listing as a data source, then only the ranges that a manifest wants.

The listing reads an archive's central directory, one partition for each archive. Wanted members are found by a join; their ranges are
dealt out by stretches of the archives and read in order, neighbours in one request. So an archive of which little is wanted costs
little, and one of which nearly all is wanted is read once, from front to back, by several tasks, without a copy of it anywhere.

An opener makes ``read(start, size) -> bytes`` and the size of an archive from its address. ``http_ranges`` is the usual one; it is named as
"module:function", as options of a data source are text.

Cases: a member that the archive lacks, or whose bytes are damaged, has no content and a reason; an archive that can't be listed raises
after its retries; a member that the manifest names twice is returned twice; an empty manifest gives no rows.
"""

from __future__ import annotations

import importlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .seams import with_retries

LISTING = "archive string, member string, start long, packed long, size long, method int, crc long"
HTTP = "quorum.sources.archives:http_ranges"
#: A member's local header: signature, the lengths of its name and extra field, and its bytes before those (a fixed format).
_LOCAL, _FIXED = "<4s22xHH", 30
_SIGNATURE = b"PK\x03\x04"


def http_ranges(address: str) -> tuple[Callable[[int, int], bytes], int]:
    """Ranges of an address over HTTP, each tried four times."""
    from urllib.request import Request, urlopen

    def ask(method: str, headers: dict) -> tuple[bytes, str]:
        with urlopen(Request(address, method=method, headers=headers), timeout=60) as answer:
            return answer.read(), answer.headers.get("Content-Length", "0")

    size = int(with_retries(lambda: ask("HEAD", {}))[1])
    return lambda start, n: with_retries(lambda: ask("GET", {"Range": f"bytes={start}-{start + n - 1}"}))[0], size


def opened(opener: str, address: str) -> tuple[Callable[[int, int], bytes], int]:
    module, name = opener.split(":")
    return getattr(importlib.import_module(module), name)(address)


class _Seekable(io.RawIOBase):
    """Ranges as a raw file, which the standard library buffers and reads a directory from."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        super().__init__()
        self.fetch, self.size, self.place = read, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = max(0, offset + (0, self.place, self.size)[whence])
        return self.place

    def readinto(self, room) -> int:
        n = min(len(room), self.size - self.place)
        if n > 0:
            room[:n] = self.fetch(self.place, n)
            self.place += n
        return max(n, 0)


class _Archive(InputPartition):
    def __init__(self, address: str):
        super().__init__(address)
        self.address = address


class _Lister(DataSourceReader):
    def __init__(self, options: dict):
        self.addresses, self.opener = json.loads(options["archives"]), options.get("opener", HTTP)

    def partitions(self) -> list[InputPartition]:
        return [_Archive(a) for a in self.addresses]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        raw = _Seekable(*opened(self.opener, partition.address))
        with zipfile.ZipFile(io.BufferedReader(raw, 1 << 16)) as archive:
            for m in archive.infolist():
                if not m.is_dir():
                    yield partition.address, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC


class ZipListing(DataSource):
    """The members of the archives named in the option ``archives`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "zip_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options)


def listing(spark: SparkSession, archives: list[str], opener: str = HTTP) -> DataFrame:
    """archive, member, start, packed, size, method, crc of every member; archives are listed in parallel."""
    spark.dataSource.register(ZipListing)
    return spark.read.format("zip_listing").option("archives", json.dumps(archives)).option("opener", opener).load()


def stretches(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int]]:
    """Ranges (start, end) in order, joined where the gap is small and the whole does not get too long."""
    out: list[tuple[int, int]] = []
    for start, end in ranges:
        if out and start - out[-1][1] <= gap and max(end, out[-1][1]) - out[-1][0] <= most:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _unpacked(data: bytes, packed: int, size: int, method: int, crc: int) -> bytes:
    signature, name, extra = struct.unpack_from(_LOCAL, data)
    if signature != _SIGNATURE:
        raise ValueError("no member begins here")
    body = data[_FIXED + name + extra :][:packed]
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression {method} is not read")
    content = body if method == zipfile.ZIP_STORED else zlib.decompress(body, -zlib.MAX_WBITS)
    if len(content) != size or zlib.crc32(content) != crc:
        raise ValueError("damaged")
    return content


def members(wanted: DataFrame, listed: DataFrame, opener: str = HTTP, gap: int = 1 << 16, stretch: int = 32 << 20) -> DataFrame:
    """image_id, content, reason for each row (image_id, archive, member) of a manifest."""
    found = wanted.select("image_id", "archive", "member").join(listed, ["archive", "member"], "left")
    lacking = found.where("start is null").select("image_id", F.lit(None).cast("binary").alias("content"), F.lit("not in the archive").alias("reason"))

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers: dict[str, Callable[[int, int], bytes]] = {}
        for part in parts:
            for address, rows in part.groupby("archive", sort=False):
                if address not in readers:
                    readers.clear()  # rows come by archive
                    readers[address] = opened(opener, address)[0]
                # a local header's extra field is not listed: a kilobyte covers any that packers write, and a longer one is found damaged
                rows = rows.sort_values("start")
                ends = rows["start"] + _FIXED + rows["member"].str.encode("utf-8").str.len() + 1024 + rows["packed"]
                for begin, end in stretches(list(zip(rows["start"], ends, strict=True)), gap, stretch):
                    data = readers[address](int(begin), int(end - begin))
                    out = []
                    for r in rows[(rows["start"] >= begin) & (rows["start"] < end)].itertuples(index=False):
                        try:
                            out.append((r.image_id, _unpacked(data[r.start - begin :], r.packed, r.size, r.method, r.crc), None))
                        except (ValueError, struct.error, zlib.error) as error:
                            out.append((r.image_id, None, str(error)[:200]))
                    yield pd.DataFrame(out, columns=["image_id", "content", "reason"])

    dealt = found.where("start is not null").withColumn("near", F.floor(F.col("start") / stretch)).repartition("archive", "near").sortWithinPartitions("archive", "start")
    got = dealt.drop("near").mapInPandas(fetch, "image_id string, content binary, reason string")
    return got.unionByName(lacking.select(F.col("image_id").cast("string").alias("image_id"), "content", "reason"))
