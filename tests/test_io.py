"""Sources, sinks, seams and streams on small files."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorum.sources import readers, seams, sinks
from quorum.streaming import limiter


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps({"info": 1, "annotations": [{"id": 1, "x": "é"}, {"id": 2, "x": None}]}))
    assert [tuple(r) for r in readers.json_list(spark, a, "annotations", "struct<id:long,x:string>").collect()] == [(1, "é"), (2, None)]
    assert readers.json_array(spark, put(tmp_path / "b.json", '[{"id": 5},\n {"id": 6}]'), "id long").count() == 2
    keyed = put(tmp_path / "k.json", '{"q1": {"n": 1},\n "q2": {"n": 2}}')
    assert sorted(tuple(r) for r in readers.keyed_object(spark, keyed, "struct<n:int>").collect()) == [("q1", 1), ("q2", 2)]
    one, two = put(tmp_path / "train.json", '{"n": 1}\n{"n": 2}\n'), put(tmp_path / "val.jsonl", '{"n": 3}\n')
    assert sorted(tuple(r) for r in readers.json_lines(spark, [one, two], "n int", "split").collect()) == [(1, "train"), (2, "train"), (3, "val")]
    csv = put(tmp_path / "v.csv", "c2,name,c1\n4,x.jpg,3\n")
    assert tuple(readers.csv_table(spark, csv, "name string, c1 int").first()) == ("x.jpg", 3)
    assert [r.id for r in readers.id_list(spark, put(tmp_path / "ids.txt", "a\n\n b \n")).collect()] == ["a", "b"]
    missing = readers.optional(spark, str(tmp_path / "none.jsonl"), "a int, b string")
    assert missing.count() == 0 and missing.columns == ["a", "b"] and readers.optional(spark, two, "n int").count() == 1


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("i1", 2, "b"), ("i1", 1, "a"), ("i2", 1, "c")], "image_id string, pos int, q string")
    assert sinks.write_json_lines(frame, str(tmp_path / "out")) == 3
    nested = {r.image_id: [x.q for x in r.questions] for r in sinks.nested(frame, "image_id", ["pos"]).collect()}
    assert nested == {"i1": ["a", "b"], "i2": ["c"]}
    sinks.write_ids_by_split(frame.withColumn("split", F.when(F.col("pos") == 1, "train").otherwise("val")), str(tmp_path / "ids"))
    assert sorted(x for x in os.listdir(tmp_path / "ids") if "=" in x) == ["split=train", "split=val"]
    sinks.write_with_dead_letters(frame, F.col("q") == "c", str(tmp_path / "good"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.json(str(tmp_path / "dead")).count() == 1
    sinks.write_with_dead_letters(frame, F.lit(False), str(tmp_path / "good2"), str(tmp_path / "dead2"))
    assert not os.path.exists(tmp_path / "dead2")
    assert json.loads(sinks.report_json(frame.orderBy("q")))[0]["q"] == "a"
    page = sinks.report_html(frame.withColumn("q", F.lit("<x>")).orderBy("pos", "image_id"), "T & U")
    assert "&lt;x&gt;" in page and "T &amp; U" in page
    with pytest.raises(ValueError, match="at most"):
        sinks.report_json(frame, 2)


def test_append_resumes(spark, tmp_path):
    path, calls = str(tmp_path / "labels"), []
    work = spark.range(20).withColumnRenamed("id", "k")

    def label(todo):
        calls.append(todo.count())
        return todo.withColumn("v", F.col("k") * 2)

    sinks.append_missing(work.where("k < 12"), path, ["k"], label)
    sinks.append_missing(work, path, ["k"], label)
    done = spark.read.parquet(path)
    assert done.count() == 20 and done.select("k").distinct().count() == 20 and sum(calls) == 20


def test_seams(spark):
    rows = spark.createDataFrame([(k, f"i{k % 3}", f"p{k}") for k in range(9)], "k long, image string, prompt string")
    said = seams.call_model(rows, lambda: lambda part: [len(p) + 0.5 for p in part["prompt"]], "prompt", "score", "double", "image")
    assert said.count() == 9 and {r.score for r in said.collect()} == {2.5}
    verdicts = seams.mean_verdict(spark.createDataFrame([("a", 0.9), ("a", 0.2), ("b", 0.1)], "q string, p double"), ["q"], "p")
    assert {r.q: r.yesno_ok for r in verdicts.collect()} == {"a": True, "b": False}

    def factory():
        def get(url, archive, member):
            if member == "bad":
                raise OSError("not found")
            return f"{archive or url}:{member}".encode()

        return get

    manifest = spark.createDataFrame([("1", None, "z", "m"), ("2", "u", None, None), ("3", None, "z", "bad")], "image_id string, url string, archive string, member string")
    got = {r.image_id: (r.content and bytes(r.content), r.reason) for r in seams.fetch(manifest, factory, attempts=2, base=0.0).collect()}
    assert got == {"1": (b"z:m", None), "2": (b"u:None", None), "3": (None, "not found")}
    waits = []
    with pytest.raises(ValueError):
        seams.with_retries(lambda: int("x"), 4, 2.0, waits.append)
    assert waits == [2.0, 4.0, 8.0]


def test_streaming_limiter_equals_the_batch_one(spark, tmp_path):
    """Requests come out of order, the stream stalls and is started again from its checkpoint; a last request moves the watermark on."""
    import random

    from quorum.operators.stateful import rate_limit

    rng = random.Random(8)
    rows = [(k % 4, 100 + k + 0.25 * (k % 3), k) for k in range(120)]  # no request is as old as the first watermark, 1970
    come = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 15))  # up to fifteen seconds late
    schema = "user long, t double, event_id long"
    batch = {r.event_id: r.accepted for r in rate_limit(spark.createDataFrame(rows, schema), "user", "t", "event_id", 2, 30.0).collect()}
    source, got = str(tmp_path / "in"), {}

    def run(name, parts):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        limited = limiter.stream_rate_limit(stream, "user", 2, 30.0, late="20 seconds")
        query = limited.writeStream.foreachBatch(lambda rows, _: got.update({(r.event_id, name): r.accepted for r in rows.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    run("first", [come[:30], come[30:60]])
    run("second", [come[60:]])  # long after in processing time, as far as the state can tell
    run("third", [[(0, 1000.0, 999)], [(1, 2000.0, 1000)]])
    said = {}
    for (event, _), accepted in got.items():
        assert event not in said  # none is decided twice
        said[event] = accepted
    assert {k: v for k, v in said.items() if k < 999} == batch


def test_label_loop_writes_a_replayed_batch_once(spark, tmp_path):
    from quorum.streaming import labels

    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    mark = lambda rows: rows.withColumn("label", F.col("id") * 2)
    calls = []

    def killed(batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("killed between write and commit")

    with pytest.raises(Exception, match="killed"):
        labels.label_loop(stream(), mark, out, cp, after=killed).awaitTermination(90)
    assert labels.labelled(spark, out).count() == 20  # the batch is whole, though the engine doesn't know yet
    labels.label_loop(stream(), mark, out, cp, after=killed).awaitTermination(90)
    rows = labels.labelled(spark, out).collect()
    assert sorted(r.id for r in rows) == list(range(30)) and all(r.label == 2 * r.id for r in rows) and calls == [0, 1, 1, 2]
    spark.range(5).write.parquet(f"{out}/batch=7")
    (tmp_path / "out" / "batch=7" / "_SUCCESS").unlink()
    assert labels.labelled(spark, out).count() == 30  # what was never finished doesn't count
    assert labels.labelled(spark, str(tmp_path / "none")) is None


def test_streaming_windows(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    query = limiter.stream_event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    from quorum.plans.stateful import event_windows

    assert spark.sql("select sum(n) from windows").first()[0] == event_windows(spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0]
