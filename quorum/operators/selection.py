"""Selection of a training set: caps by source, balanced teacher questions, variants with fewer options, images kept.

A question has ``id``, ``image``, ``split``, ``source``, ``teacher`` (whether a model labelled it), ``type``, ``topic``, ``opening``, ``p_yes``
(ten-thousandths, for yes/no questions with a target), ``options`` and ``target`` (of choice questions). Only the training split is selected.

Scale: a cap is found by counts of hash digits, so a hot source is never one task; the loops of the balancing run over groups above a
cap, at most 1 / share of them; variants are made in their row. What is kept is checkpointed between the steps, which read it again.

Cases: a source without a cap is kept whole; null sources, topics and openings are groups of their own; a question without target gets no variant
and no part in the yes-rate; ids must be distinct (``first_wins`` before makes them so); an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import dist, hashing
from . import balance, integrate, order_statistics

#: The yes-rate is in ten-thousandths.
WHOLE = 10_000


def capped(rows: DataFrame, caps: dict[str, int], seed: str = "cap") -> DataFrame:
    """At most so many questions of each source, those with the smallest hashes."""
    table = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)) if caps else F.create_map().cast("map<string,int>")
    limit = F.coalesce(F.try_element_at(table, F.col("source")).cast("long"), F.lit(1 << 62))
    key = hashing.order_key(F.lit(seed), F.coalesce("source", F.lit("")), F.col("id").cast("string"))
    return order_statistics.bottom_k(rows, ["source"], key, limit, ["id"])


def balanced(rows: DataFrame, topic_cap: float, opening_cap: float, yes_most: float, yes_goal: float) -> tuple[DataFrame, DataFrame]:
    """Teacher questions without the surplus of any topic or opening, and of yes; (kept, why) with the number of drops by reason.

    Drops take from the images with the most questions first, as the drops before left them.
    """
    teacher = checkpointed(rows.where("teacher"))
    n = teacher.count()
    density = rows.groupBy("image").agg(F.count(F.lit(1)).alias("density"))
    by_topic, density = balance.capped_groups(teacher, "topic", "image", "id", topic_cap, n, density, "topic")
    by_opening, density = balance.capped_groups(by_topic, "opening", "image", "id", opening_cap, n, density, "opening")
    asked = by_opening.where("type = 'bool' and p_yes is not null")
    total, many = asked.agg(F.sum("p_yes"), F.count(F.lit(1))).first()
    dropped = by_opening.select("id").limit(0)
    if many and total > yes_most * WHOLE * many:
        heavy = asked.where(F.col("p_yes") > WHOLE // 2).join(density, "image").withColumn("fewer", -F.col("density"))
        order = [F.col("fewer"), hashing.order_key(F.lit("yes"), F.col("id").cast("string")), F.col("id")]
        dropped = checkpointed(integrate.prefix_until(heavy, order, F.col("p_yes"), F.lit(total), F.lit(many), yes_goal * WHOLE).select("id"))
    kept = checkpointed(by_opening.join(dropped, "id", "left_anti"))
    sizes = (("topic", teacher, by_topic), ("opening", by_topic, by_opening), ("yes", by_opening, kept))
    why = rows.sparkSession.createDataFrame([(name, a.count() - b.count()) for name, a, b in sizes], "reason string, n long")
    return kept.unionByName(rows.where(~F.coalesce("teacher", F.lit(False)))), why


def variants(rows: DataFrame, share: float, seed: str = "aug") -> DataFrame:
    """For a share of the choice questions that people labelled: the winner and one or two losers, renormalised and shuffled."""
    key = F.col("id").cast("string")
    eligible = rows.where((F.col("type") == "choice") & F.col("target").isNotNull() & (F.size("options") > 2) & ~F.coalesce("teacher", F.lit(False)))
    chosen = eligible.where(hashing.uniform(F.lit(seed), key) < share)
    losers = F.when(F.size("options") > 3, 1 + hashing.h32(F.lit("k"), key) % 2).otherwise(1).cast("int")

    def mixed(winner: Column) -> Column:
        items = F.zip_with("options", "target", lambda o, t: F.struct(o.alias("o"), t.alias("t")))
        placed = F.transform(items, lambda x, i: F.struct((i != winner).cast("int").alias("lost"), hashing.order_key(F.lit("lose"), key, x["o"]).alias("h"), x["o"].alias("o"), x["t"].alias("t")))
        few = F.slice(F.array_sort(placed), F.lit(1), losers + 1)
        return F.array_sort(F.transform(few, lambda x: F.struct(hashing.order_key(F.lit("mix"), key, x["o"]).alias("h"), x["o"].alias("o"), x["t"].alias("t"))))

    made = chosen.withColumn("options", dist.bound(dist.argmax(F.col("target")), mixed))
    return made.withColumns({"target": dist.normalised(F.transform("options", lambda x: x["t"])), "options": F.transform("options", lambda x: x["o"])})


def select(questions: DataFrame, manifest: DataFrame, caps: dict[str, int], topic_cap: float = 0.08, opening_cap: float = 0.008, yes_most: float = 0.55, yes_goal: float = 0.5, share: float = 0.5) -> dict[str, DataFrame]:
    """``questions`` (with ``aug``), ``images`` (rows of the manifest), ``ids`` (split, image) and ``why`` (drops by reason)."""
    train = checkpointed(capped(questions.where("split = 'train'"), caps))
    kept, why = balanced(train, topic_cap, opening_cap, yes_most, yes_goal)
    others = questions.where(~F.coalesce(F.col("split") == "train", F.lit(False)))
    made = [f.withColumn("aug", F.lit(mark)) for f, mark in ((others, False), (kept, False), (variants(kept, share), True))]
    every = checkpointed(made[0].unionByName(made[1]).unionByName(made[2]))
    ids = every.select("split", "image").distinct()
    return {"questions": every, "images": manifest.join(ids.select("image").distinct(), "image", "left_semi"), "ids": ids, "why": why}
