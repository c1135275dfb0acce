import random

import pytest
from pyspark.sql import functions as F

from quorum.functions import rules
from quorum.operators import builders, increments, integrate, ordinal, stateful
from quorum.streaming import writers

ROWS = "id long, image string, q string, fine boolean, held boolean, key string"


def made(spark, n=900):
    """Rows of which a third share one key, with null keys and columns whose names clash with helpers."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]) if i % 3 else "hot", rng.choice(["x", "y", "z", None, *map(str, range(60))]) if i % 3 else "hot", rng.random() > 0.2, rng.random() < 0.2, "own") for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def merged(frame, kept, batch):
    invalid = F.when(~F.col("fine"), "invalid")
    return increments.merge_increment(frame, ["image", "q"], [F.col("id")], invalid, F.col("held"), kept, batch)


@pytest.fixture
def kept(spark):
    keys = increments.KeptKeys(spark, buckets=3)
    yield keys
    keys.drop()


def reasons(frame):
    return {r.id: r.reason for r in frame.select("id", "reason").collect()}


def test_increments_equal_one_merge(spark, kept):
    frame = made(spark)
    want = reasons(integrate.merge_reasons(frame, ["image", "q"], [F.col("id")], F.when(~F.col("fine"), "invalid"), F.col("held")))
    assert set(want.values()) == {None, "invalid", "duplicate", "held-out"}
    parts = [frame.where(F.col("id").between(300 * k, 300 * k + 299)) for k in range(3)]
    got = {}
    for k, part in enumerate(parts):
        done = merged(part, kept, k)
        assert done.columns == [*frame.columns, "reason"]
        got |= reasons(done)
    assert got == want
    stored = spark.table(kept.name)
    assert stored.count() == sum(r is None for r in want.values()) == stored.select("key").distinct().count()
    again = reasons(merged(parts[1], kept, 1))  # a batch that is merged again: the same reasons, the same keys
    assert again == {i: want[i] for i in again} and len(again) == 300
    assert spark.table(kept.name).count() == stored.count() == sum(r is None for r in want.values())
    assert merged(frame.limit(0), kept, 3).count() == 0


def test_kept_keys_are_found_again_by_another_owner(spark, kept):
    frame = made(spark, 60)
    first = reasons(merged(frame, kept, 0))
    spark.sql(f"drop table {kept.name}")  # the catalog forgets, the files stay
    opened = increments.KeptKeys(spark, kept.name, kept.folder, buckets=3)
    later = reasons(merged(frame, opened, 1))
    fine = {r.id for r in frame.where("fine").collect()}
    assert None in first.values()
    seen = {(r.image, r.q) for r in frame.collect() if first[r.id] is None}
    assert all(later[r.id] == "duplicate" for r in frame.collect() if r.id in fine and (r.image, r.q) in seen)
    assert None not in later.values()


def test_kept_keys_are_not_shuffled(spark, kept):
    merged(made(spark, 90), kept, 0)
    firsts = spark.createDataFrame([("k", 1)], "key string, first long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = increments.known_keys(firsts, kept, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange") == 1  # that of the new rows
    store = plan[plan.index("FileScan") :]
    assert "Bucketed: true" in store and "Exchange" not in store


def questions(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text")
    near = docs.where("doc_id % 4 = 1").select("source", (F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" further")).alias("text"))
    empty = spark.createDataFrame([("s", 200_000, ""), ("s", 200_001, ""), ("s", 200_002, "one"), ("s", 200_003, "One one")], docs.schema)
    rows = docs.unionByName(near).unionByName(empty).where("text is not null")
    edges = [r[0] for r in rows.select(F.expr("percentile(doc_id, array(0.3, 0.6))")).collect()][0]
    for k, (a, b) in enumerate(zip([-1, *edges], [*edges, 1e9], strict=True)):
        rows.where((F.col("doc_id") > a) & (F.col("doc_id") <= b)).coalesce(1).write.parquet(f"{path}/part{k}")
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_writers_loop_equals_the_fold_and_resumes(spark, rocks, tmp_path):
    import shutil

    rows = questions(spark, str(tmp_path / "made"))
    want = {r.doc_id for r in stateful.without_near_duplicates(rows, "source", "doc_id", "text").collect()}
    assert 0 < len(want) < rows.count()
    (tmp_path / "in").mkdir()
    out, taken = str(tmp_path / "out"), []
    for k in range(3):  # each time the query is started anew and goes on from its checkpoint
        for f in (tmp_path / "made" / f"part{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept = writers.stream_without_near_duplicates(stream, "source", "doc_id", "text")
        query = kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
        taken.append(spark.read.parquet(out).count())
    assert taken == sorted(taken) and taken[0] > 0
    got = [r.doc_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_zip_needs_equal_lengths(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x long"), spark.createDataFrame([("r", True), ("q", False), ("s", None)], "y string, here boolean")
    got = ordinal.zipped(a, b, ["x"], ["y"])
    assert sorted((r.row_id, r.x, r.y, r.here) for r in got.collect()) == [(1, 1, "q", False), (2, 2, "r", True), (3, 3, "s", None)]
    for left, right in ((a, b.limit(2)), (a.limit(1), b), (a, b.limit(0))):
        with pytest.raises(Exception, match="lengths differ"):
            ordinal.zipped(left, right, ["x"], ["y"]).collect()
    assert ordinal.zipped(a.limit(0), b.limit(0), ["x"], ["y"]).count() == 0


def test_types_have_one_owner(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "type string, n long")
    assert sorted(tuple(r) for r in integrate.owned_once(good, "type").collect()) == [("a", 1), ("b", 2)]
    for row in (("a", 3), (None, 3)):
        with pytest.raises(Exception, match="not owned exactly once"):
            integrate.owned_once(good.unionByName(spark.createDataFrame([row], good.schema)), "type").collect()


def test_attribute_questions(spark):
    rows = [
        (1, "chair", ["Wooden ", "wood", "old"]),  # two words for one material
        (2, "chair", ["wood"]), (2, "Chair ", ["metal"]),  # the name is not unique
        (3, "scissors", ["metal", "plastic"]),  # two materials
        (4, "glass table", ["stone"]),  # the name holds a material
        (5, "bus", ["cement"]), (6, "doors", ["cloth"]), (7, "x", None), (8, None, ["wood"]),
    ]
    frame = spark.createDataFrame(rows, "image long, name string, of array<string>")
    values = sorted(set(rules.MATERIALS.values()))
    got = {r.image: r for r in builders.attribute_questions(frame, "image", "name", "of", rules.material, values, list(rules.MATERIALS), "What ", " made of?").collect()}
    assert {i: (r.answer, r.q) for i, r in got.items()} == {1: ("wood", "What is the chair made of?"), 5: ("concrete", "What is the bus made of?"), 6: ("fabric", "What are the doors made of?")}
    assert all(len(set(r.options)) == 4 and r.answer in r.options and set(r.options) <= set(values) for r in got.values())
