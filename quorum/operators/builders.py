"""Question builders: from votes, answers, histograms and attributes to targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text


def vote_spread_bool(votes: DataFrame, key: str, answer: str, yes: str, no: str, least: int = 8) -> DataFrame:
    """Per key the shares of yes and no among plain votes, for keys with at least ``least`` of them."""
    n_yes, n_no = F.count_if(F.col(answer) == yes), F.count_if(F.col(answer) == no)
    counted = votes.groupBy(key).agg(n_yes.alias("n_yes"), n_no.alias("n_no")).where(F.col("n_yes") + F.col("n_no") >= least)
    p = F.round(F.col("n_yes") / (F.col("n_yes") + F.col("n_no")), 4)
    return counted.withColumn("p_yes", p).withColumn("p_no", F.round(1 - F.col("p_yes"), 4))


def modal_answers(votes: DataFrame, key: str, answer: str, order: list[str]) -> DataFrame:
    """Per key and answer the count, and its rank; ties go to the answer that came first in ``order``."""
    numbered = votes.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    counts = numbered.groupBy(key, answer).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first_pos")))


def answer_pools(votes: DataFrame, kind: str, answer: str, top: int, least: int, coverage: float) -> DataFrame:
    """Per kind the ``top`` most frequent answers with counts, for kinds that are large and covered enough (A4)."""
    counts = votes.groupBy(kind, answer).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(kind)
    ranked = counts.withColumn("rk", F.row_number().over(by.orderBy(F.desc("n"), answer))).withColumn("total", F.sum("n").over(by))
    held = F.sum(F.when(F.col("rk") <= top, F.col("n"))).over(by)
    return ranked.withColumn("held", held).where((F.col("rk") <= top) & (F.col("total") >= least) & (F.col("held") >= coverage * F.col("total"))).select(kind, answer, "n", "rk")


def weighted_pick(frame: DataFrame, group: str, weight: Column, k: int, *key: Column | str) -> DataFrame:
    """k rows of each group, drawn without replacement in proportion to the weight."""
    draw = hashing.exponential_key(weight, *key)
    return frame.withColumn("draw", draw).withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy("draw"))).where(F.col("pick") <= k).drop("draw")


def histogram_target(counts: list[Column]) -> Column:
    """Shares of vote counts, rounded to four places."""
    total = sum(counts[1:], counts[0])
    return F.transform(F.array(*counts), lambda c: F.round(c / total, 4))


def cooccurrence(members: DataFrame, group: str, item: str) -> DataFrame:
    """In how many groups two items occur together, each with itself too."""
    once = members.select(group, item).distinct()
    other = once.select(F.col(group), F.col(item).alias("b"))
    return once.withColumnRenamed(item, "a").join(other, group).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def attribute_questions(objects: DataFrame, image: str, name: str, attributes: str, value: Callable[[Column], Column], vocabulary: list[str], leaks: list[str], opening: str, ending: str) -> DataFrame:
    """image, name, answer, options and q: one question about an attribute for each image that can have one.

    Of the objects whose name is unique in the image and whose attributes stand for exactly one value, one is drawn by hash. Three other
    values of the vocabulary join the answer, in an order by hash. Names that hold one of the words of ``leaks`` give no question, but
    only after the draw, so that they change no other image's question. Objects of an image are never gathered: they are counted by
    name, and one is kept by an aggregation.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    named = objects.select(image, F.lower(F.trim(name)).alias(name), F.array_distinct(F.array_compact(F.transform(attributes, value))).alias("values"))
    unique = named.groupBy(image, name).agg(F.count(F.lit(1)).alias("n"), F.first("values").alias("values")).where("n = 1 and size(values) = 1")
    key = lambda *parts: hashing.order_key(F.col(image).cast("string"), *parts)
    drawn = unique.groupBy(image).agg(F.min_by(F.struct(name, F.element_at("values", 1).alias("answer")), F.struct(key(F.col(name)), F.col(name))).alias("of")).select(image, f"of.{name}", "of.answer")
    others = F.array_sort(F.transform(F.array_remove(F.array(*(F.lit(v) for v in vocabulary)), F.col("answer")), lambda v: F.struct(key(v).alias("h"), v.alias("v"))))
    options = F.array_sort(F.transform(F.array_append(F.transform(F.slice(others, 1, 3), lambda x: x["v"]), F.col("answer")), lambda v: F.struct(key(F.lit("place"), v).alias("h"), v.alias("v"))))
    q = F.concat(F.lit(opening), text.agreement(F.col(name)), F.lit(" the "), F.col(name), F.lit(ending))
    return drawn.where(~F.arrays_overlap(words(F.col(name)), F.array(*(F.lit(w) for w in leaks)))).select(image, name, "answer", F.transform(options, lambda x: x["v"]).alias("options"), q.alias("q"))


def absent_items(members: DataFrame, group: str, item: str) -> DataFrame:
    """For each group the array of items that it lacks (J14): the list of all items is small and broadcast."""
    all_items = members.agg(F.array_sort(F.collect_set(item)).alias("every"))
    own = members.groupBy(group).agg(F.collect_set(item).alias("own"))
    return own.crossJoin(F.broadcast(all_items)).select(group, F.array_except("every", "own").alias("absent"))


def unique_within(members: DataFrame, group: str, name: Column) -> DataFrame:
    """Names that occur exactly once in their group."""
    return members.select(group, name.alias("name")).groupBy(group, "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def crosswalk(ids: DataFrame, key: str, table: DataFrame, target: str, mapped: str, unmapped: str) -> DataFrame:
    """Translate ids by a table: mapped ones, known ones without a target (null or 0), unknown ones null.

    The planner broadcasts the table if its size allows, as measured; else both sides are shuffled by the id.
    """
    known = table.select(F.col(key), F.col(target).alias("__to"), F.lit(True).alias("__known"))
    to = F.coalesce("__to", F.lit(0))
    new = F.when(to != 0, F.format_string(mapped, "__to")).when(F.col("__known"), F.format_string(unmapped, key))
    return ids.join(known, key, "left").withColumn("mapped", new).drop("__to", "__known")
