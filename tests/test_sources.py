import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quorum.sources import archives, files

LOCAL = "test_sources:local_ranges"


def local_ranges(address):
    """A double of a server of ranges: a local file, and a log of what was asked."""
    import os

    def read(start, n):
        with open(address, "rb") as f, open(f"{address}.log", "a") as log:
            log.write(f"{start} {n}\n")
            f.seek(start)
            return f.read(n)

    return read, os.path.getsize(address)


@pytest.fixture
def zips(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)  # the executors import the double by its name
    pages = [(r.page_id, r.html.encode()) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(60).collect()]
    made = {}
    for k in range(3):
        path = str(tmp_path / f"a{k}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            z.writestr("folder/", b"")
            for i, content in pages[k::3]:
                z.writestr(f"folder/{i}é.html", content)
                made[path, f"folder/{i}é.html"] = content
    return made


def test_members_by_ranges(spark, zips):
    paths = sorted({a for a, _ in zips})
    listed = archives.listing(spark, paths, LOCAL)
    assert listed.rdd.getNumPartitions() == len(paths)  # one partition for each archive
    assert {(r.archive, r.member): r.size for r in listed.collect()} == {k: len(v) for k, v in zips.items()}
    wanted = [(f"{k}", *key) for k, key in enumerate(sorted(zips)) if k % 4 == 0]
    rows = [*wanted, ("twice", *wanted[0][1:]), ("none", paths[0], "folder/none"), ("null", None, None)]
    frame = spark.createDataFrame(rows, "image_id string, archive string, member string")
    got = {r.image_id: (r.content and bytes(r.content), r.reason) for r in archives.members(frame, listed, LOCAL).collect()}
    assert got == {i: (zips[a, m], None) if (a, m) in zips else (None, "not in the archive") for i, a, m in rows}
    assert archives.members(frame.limit(0), listed, LOCAL).count() == 0


def test_nearly_whole_archives_are_read_in_few_requests(spark, zips):
    import os

    path = sorted({a for a, _ in zips})[1]
    listed = archives.listing(spark, [path], LOCAL).cache()
    assert listed.count()
    os.remove(f"{path}.log")
    rows = spark.createDataFrame([(m, a, m) for a, m in sorted(zips) if a == path], "image_id string, archive string, member string")
    assert archives.members(rows, listed, LOCAL).where("content is not null").count() == rows.count()
    asked = [tuple(map(int, x.split())) for x in open(f"{path}.log")]
    assert len(asked) == 1 and asked[0][1] < os.path.getsize(path) + 4096  # all neighbours, so one request
    listed.unpersist()


def test_damaged_members_have_a_reason(spark, zips):
    path = sorted({a for a, _ in zips})[0]
    listed = archives.listing(spark, [path], LOCAL).withColumn("crc", F.lit(1).cast("long"))
    rows = listed.select(F.col("member").alias("image_id"), "archive", "member").limit(2)
    assert {r.reason for r in archives.members(rows, listed, LOCAL).collect()} == {"damaged"}


def test_stretches():
    assert archives.stretches([(0, 10), (12, 20), (100, 110)], 5, 1000) == [(0, 20), (100, 110)]
    assert archives.stretches([(0, 10), (10, 20), (20, 30)], 5, 20) == [(0, 20), (20, 30)]
    assert archives.stretches([], 5, 20) == []


def test_file_scan(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").cast("string").alias("image_id"), "html").orderBy("page_id").limit(40).collect()
    for k, r in enumerate(pages):
        if k != 7:
            folder = tmp_path / f"part{k % 3}"
            folder.mkdir(exist_ok=True)
            (folder / f"{r.image_id}.v1.html").write_text(r.html) if k == 3 else (folder / f"{r.image_id}.html").write_text(r.html)
    listed = files.file_listing(spark, str(tmp_path), "*.html")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()  # nothing is opened
    rows = spark.createDataFrame([(r.image_id, len(r.html.encode()), "x") for r in pages if r.image_id != pages[3].image_id] * 2, "image_id string, n long, path_ string")
    got = files.with_files(rows, listed).collect()
    assert len(got) == 2 * 38 and all(r.length == r.n for r in got)
    with pytest.raises(ValueError, match="of 39 images"):
        files.with_files(rows, listed, least=0.99)
    assert files.with_files(rows.limit(0), listed).count() == 0


def test_png_sizes(spark, tmp_path):
    head = bytes.fromhex(files.PNG) + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    for name, data in (("a.png", head + b"x" * 50), ("b.png", head[:20]), ("c.png", b"GIF89a" + b"x" * 50), ("d.png", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.width, r.height) for r in files.png_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (640, 480), "b.png": (None, None), "c.png": (None, None)}
