"""Queries of reports: soft labels, composite histograms, positions, evaluation by type; orders of files and keys of caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import metrics, ordinal
from . import build, evaluate, select
from .common import split_of, table


def soft_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the share of questions whose target is no certainty."""
    rows = build.vote_spread_bool(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_brand"), "part_id")
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.greatest("p_yes", "p_no") < 0.999).cast("double")), 6).alias("soft"))


def composite_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of options, scales with their anchors, and N/A by source and split, as (kind, key, n)."""
    options = build.vote_spread_choice(spark, sf_dir).select(F.lit("options").alias("kind"), F.size(F.split("options", ",")).cast("string").alias("key"))
    scales = table(spark, sf_dir, "orders").select(F.lit("scale"), F.concat_ws("|", F.col("o_orderstatus"), F.col("o_orderpriority")))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    na = docs.select(F.lit("na"), F.concat_ws("|", F.col("source"), hashing.split_of(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))))
    return options.union(scales).union(na).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


HISTOGRAMS = f"""
select 'options' as kind, len(string_split(options, ','))::VARCHAR as key, count(*) as n from ({build.SQL["vote_spread_choice"]}) group by 2
union all select 'scale', o_orderstatus || '|' || o_orderpriority, count(*) from orders group by 2
union all select 'na', source || '|' || {split_of("'doc_' || doc_id")}, count(*) from documents where doc_id in (select doc_id from labels where quality = 0) group by 2"""


def position_deviation(spark: SparkSession, sf_dir: str, least: int = 100) -> DataFrame:
    """By number of options the largest deviation of the best option's position from uniform, for ``least`` questions or more."""
    p = F.transform(F.split("target", ","), lambda x: x.cast("double"))
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    rows = select.option_augment(spark, sf_dir).select("k", best.alias("pos"))
    counts = rows.groupBy("k", "pos").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    every = totals.select("k", "total", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("pos"))  # positions that never win count too
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return every.join(counts, ["k", "pos"], "left").groupBy("k").agg(F.first("total").alias("n"), F.round(F.max(F.abs(share - 1 / F.col("k"))), 6).alias("deviation"))


POSITIONS = f"""
with a as ({select.AUGMENT}), b as (select k, list_transform(string_split(target, ','), lambda x: x::DOUBLE) as p from a), c as (select k, list_position(p, list_max(p)) - 1 as pos, count(*) as n from b group by 1, 2),
t as (select k, sum(n)::BIGINT as total from c group by 1 having sum(n) >= 100), e as (select k, total, unnest(range(k)) as pos from t)
select k, any_value(total) as n, round(max(abs(coalesce(n, 0) / total::DOUBLE - 1 / k::DOUBLE)), 6) as deviation from e left join c using (k, pos) group by 1"""


def per_type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, loss, calibration error, accuracy and the 95th hundredth of each type, and the ranking of the ninth label (M4)."""
    rows = evaluate._scored(spark, sf_dir).withColumn("type", (F.col("label") % 3).cast("string"))
    means = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 6).alias("loss"), F.round(F.avg("acc"), 6).alias("acc"))
    ece = metrics.ece(rows, F.col("conf"), F.col("acc"), "type").select("type", F.round("ece", 6).alias("ece"))
    p95 = metrics.ranked_value(rows.select("type", F.round("conf", 6).alias("p95")), "p95", 0.95, "type")
    none = F.lit(None).cast("double")
    types = means.join(ece, "type").join(p95, "type").withColumn("auroc", none)
    ranked = metrics.auroc(rows, F.round("conf", 3), F.col("label") == 9)
    return types.unionByName(ranked.select(F.lit("na").alias("type"), F.col("positives").alias("n"), none.alias("loss"), none.alias("acc"), none.alias("ece"), none.alias("p95"), F.round("auroc", 6).alias("auroc")))


REPORT = f"""{evaluate.SCORED}, y as (select *, (label % 3)::VARCHAR as type, round(conf, 6) as c6, round(conf, 3) as c3 from scored),
b as (select type, sum(abs(c - a)) / sum(n) as ece from (select type, count(*) as n, sum(conf) as c, sum(acc) as a from y group by type, least(floor(conf * 15), 14)) group by 1),
q as (select type, c6 as p95 from (select type, c6, row_number() over (partition by type order by c6) as rn, count(*) over (partition by type) as n from y) where rn = floor(n * 0.95::DOUBLE) + 1),
means as (select type, count(*) as n, round(avg(nll), 6) as loss, round(avg(acc), 6) as acc from y group by 1),
k as (select *, avg(rn) over (partition by c3) as rk from (select *, row_number() over (order by c3) as rn from y))
select type, n, loss, acc, round(ece, 6) as ece, p95, null::DOUBLE as auroc from means join b using (type) join q using (type)
union all select 'na', count(*) filter (label = 9), null, null, null, null, round((sum(rk) filter (label = 9) - count(*) filter (label = 9) * (count(*) filter (label = 9) + 1) / 2.0) / nullif(count(*) filter (label = 9) * count(*) filter (label <> 9), 0), 6) from k"""


def file_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents in file order, by an explicit ordinal (O2); the limit is the operator's."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


def event_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 events in order; the last may be short (T4)."""
    made = ordinal.micro_batches(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 32)
    return made.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of caches: sixteen hexadecimal digits of the SHA-1 of the bytes (F2)."""
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha1(F.col("html").cast("binary")), 1, 16).alias("key"))


def verify_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one structure answered by yes or no, mapped to their image; those without an image are counted."""
    events = table(spark, sf_dir, "events").where((F.col("event_type") == "click") & F.col("value").isNotNull())
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("mapped"))
    rows = events.withColumn("yes", (F.col("value") >= 10).cast("int")).join(images, "user_id", "left")
    return rows.groupBy("yes").agg(F.count_if("mapped").alias("questions"), F.count_if(F.col("mapped").isNull()).alias("skipped"))


def capped_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users have how many events, ten standing for ten or more."""
    sizes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.least("n", F.lit(10)).alias("size")).agg(F.count(F.lit(1)).alias("users"))


QUERIES = {f.__name__: f for f in (capped_sizes, soft_share, composite_histograms, position_deviation, per_type_report, file_order_limit, event_micro_batches, cache_keys, verify_questions)}
SQL = {
    "capped_sizes": "select least(n, 10) as size, count(*) as users from (select count(*) as n from events group by user_id) group by 1",
    "soft_share": f"select p_brand, count(*) as n, round(avg((greatest(p_yes, p_no) < 0.999)::INT), 6) as soft from ({build.VOTES}) v join part on part_id = p_partkey group by 1",
    "composite_histograms": HISTOGRAMS,
    "position_deviation": POSITIONS,
    "per_type_report": REPORT,
    "file_order_limit": "select doc_id, lang from documents order by doc_id limit 100",
    "event_micro_batches": "with e as (select event_id, (row_number() over (order by event_id) - 1) // 32 as batch from events) select batch, count(*) as n, min(event_id) as first, max(event_id) as last from e group by 1",
    "cache_keys": "select page_id, substr(sha1(html), 1, 16) as key from pages",
    "verify_questions": "select (value >= 10)::INT as yes, count(c_custkey) as questions, count(*) - count(c_custkey) as skipped from events left join customer on c_custkey = user_id where event_type = 'click' and value is not null group by 1",
}
