import random

import pytest
from pyspark.sql import functions as F

from quorum.operators import integrate, order_statistics, selection
from quorum.operators.ordinal import numbered


def made(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(40), 1) for k in range(600)]
    return rows, spark.createDataFrame(rows, "id long, g string, v int, n int").repartition(5)


@pytest.mark.parametrize("levels", [(4, 8), (1, 2), (16,)])
def test_bottom_k_equals_sorting(spark, levels):
    rows, frame = made(spark)
    frame = frame.withColumn("key", F.lpad(F.col("v").cast("string"), 4, "0"))  # many ties and a clashing name
    limits = {"hot": 50, "b": 1000, None: 3}
    limit = F.when(F.col("g") == "hot", 50).when(F.col("g") == "b", 1000).otherwise(3)
    got = order_statistics.bottom_k(frame, ["g"], F.col("key"), limit, ["id"], rank="rk", levels=levels).collect()
    want = {}
    for k, g, v, _ in sorted(rows, key=lambda r: (f"{r[2]:04}", r[0])):
        want.setdefault(g, []).append(k)
    assert sorted((str(r.g), r.rk, r.id) for r in got) == sorted((str(g), i, k) for g, ks in want.items() for i, k in enumerate(ks[: limits[g]], 1))
    assert set(got[0].asDict()) == {"id", "g", "v", "n", "key", "rk"}


def test_bottom_k_without_limit_or_rows(spark):
    _, frame = made(spark)
    key = F.col("id").cast("string")
    assert order_statistics.bottom_k(frame, ["g"], key, F.lit(None).cast("int")).count() == 0
    assert order_statistics.bottom_k(frame, ["g"], key, F.lit(0)).count() == 0
    assert order_statistics.bottom_k(frame.limit(0), ["g"], key, F.lit(5)).count() == 0
    twice = frame.where("g = 'hot'").unionByName(frame.where("g = 'hot'"))
    assert order_statistics.bottom_k(twice, ["g"], key, F.lit(3)).count() == 4  # equal rows tie


def test_running_sums_and_ranked_values(spark):
    rows, frame = made(spark)
    got = {r.id: r.before for r in order_statistics.grouped_running(frame, ["g"], ["v", "id"], F.col("v"), "before").collect()}
    seen = {}
    for k, g, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[k] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
    for share in (0.0, 0.5, 0.95):
        values = {r.g: r.v for r in order_statistics.ranked_value(frame.select("g", "v"), "v", share, "g").collect()}
        assert values == {g: (own := sorted(v for _, h, v, _ in rows if h == g))[int(len(own) * share)] for g in seen}


def test_smallest_as_a_condition(spark):
    rows, frame = made(spark)
    keyed = frame.withColumn("key", F.lpad(F.col("v").cast("string"), 4, "0"))
    for limit in (1, 7, 599, 600):
        got = {r.id for r in keyed.where(order_statistics.smallest(keyed, "key", limit, ["id"], (2, 3))).collect()}
        assert got == {r[0] for r in sorted(rows, key=lambda r: (f"{r[2]:04}", r[0]))[:limit]}
    assert order_statistics.smallest(keyed, "key", 601, ["id"]) is None


def test_numbers_leave_other_columns_alone(spark):
    frame = spark.range(50).select("id", F.lit("x").alias("running"), F.lit(1).alias("range"), F.lit(2).alias("s"))
    assert numbered(frame, ["id"]).where("running <> 'x' or range <> 1 or s <> 2 or rn <> id + 1").count() == 0


def test_repeated_verdicts_multiply_no_row(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    verdicts = spark.createDataFrame([(1, True), (1, True), (2, False), (2, True), (3, None), (3, True)], "k int, ok boolean")
    got = integrate.with_verdicts(rows, verdicts, ["k"], "ok").collect()
    assert sorted((r.k, r.ok) for r in got if r.ok is not None) == [(1, True), (3, True)] and [r.k for r in got if r.ok is None] == [4]


QUESTION = "id long, image long, split string, source string, teacher boolean, type string, topic string, opening string, p_yes long, options array<string>, target array<double>"


def test_selection(spark):
    rows = [(k, k % 9, "train" if k % 10 else "test", "a" if k % 2 else None, k % 4 == 0, "bool", "t", f"o{k % 50}", 9000, None, None) for k in range(200)]
    rows += [(1000 + k, 50 + k, "train", "c", False, "choice", "t", "o", None, ["x", "y", "z", "w"], [0.1, 0.6, 0.3, 0.0]) for k in range(40)]
    rows += [(2000, 99, "train", "c", None, "choice", None, None, None, ["x", "y"], [0.5, 0.5]), (2001, None, None, "c", False, "choice", None, None, None, None, None)]
    questions = spark.createDataFrame(rows, QUESTION)
    manifest = spark.range(200).withColumnRenamed("id", "image")
    done = selection.select(questions, manifest, {"a": 20, "c": 30}, topic_cap=0.5, opening_cap=0.9)
    got = done["questions"].collect()
    own = [r for r in got if not r.aug]
    assert len({r.id for r in own}) == len(own) and {r.id for r in own if r.split == "test"} == {r[0] for r in rows if r[2] == "test"}
    assert sum(r.source == "a" and r.split == "train" for r in own) == 20 and 2001 in {r.id for r in own}
    why = {r.reason: r.n for r in done["why"].collect()}
    teachers = [r for r in rows if r[2] == "train" and r[4] and r[3] != "a"]
    kept = [r for r in own if r.teacher and r.split == "train"]
    assert why["topic"] == len(teachers) - len(teachers) // 2 and why["topic"] + why["opening"] + why["yes"] == len(teachers) - len(kept)
    made = [r for r in got if r.aug]
    assert made and all(len(r.options) in (2, 3) and "y" in r.options and sum(r.target) == pytest.approx(1) and max(r.target) == r.target[r.options.index("y")] for r in made)
    assert {r.image for r in done["images"].collect()} == {r.image for r in got if r.image is not None}
    empty = selection.select(questions.limit(0), manifest, {})
    assert all(empty[k].count() == 0 for k in ("questions", "images", "ids"))
