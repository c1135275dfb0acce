"""Queries of selection: caps, samples, permutations, shards, augmentation, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist, hashing, rules, text
from ..operators import balance, builders, integrate
from ..operators.order_statistics import grouped_running
from ..operators.ordinal import numbered
from . import build
from .common import h32, split_of, table, uniform

CAPS = {"en": 300, "fr": 60, "de": 60, "es": 200}


def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the documents with the smallest hashes, up to its cap."""
    cap = F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv))[F.col("lang")]
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return integrate.bottom_k(rows, "lang", cap, F.lit("cap"), F.col("doc_id").cast("string")).select("doc_id", "lang", "rk")


def option_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For half of the parts: the winner among line numbers and one or two losers, renormalised and shuffled."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("l_partkey").cast("string")
    ranked = counts.withColumn("rk", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("n"), "l_linenumber"))).withColumn("k_all", F.count(F.lit(1)).over(Window.partitionBy("l_partkey")))
    chosen = ranked.where((hashing.uniform(F.lit("aug"), key) < 0.5) & (F.col("k_all") > 2))
    k = F.when(F.col("k_all") > 3, 2 + (hashing.h32(F.lit("k"), key) % 2).cast("int")).otherwise(2)
    losers = Window.partitionBy("l_partkey", F.col("rk") == 1).orderBy(hashing.order_key(F.lit("lose"), key, F.col("l_linenumber").cast("string")))
    kept = chosen.withColumn("k", k).withColumn("lk", F.row_number().over(losers)).where((F.col("rk") == 1) | (F.col("lk") < F.col("k")))
    made = kept.groupBy("l_partkey", "k").agg(F.array_sort(F.collect_list(F.struct(hashing.order_key(F.lit("mix"), key, F.col("l_linenumber").cast("string")).alias("h"), F.col("l_linenumber").alias("o"), F.col("n").alias("n")))).alias("x"))
    p = dist.normalised(F.transform("x", lambda e: e["n"].cast("double")))
    return made.select("l_partkey", "k", F.array_join(F.transform("x", lambda e: e["o"].cast("string")), ",").alias("options"), dist.shown(p, 4).alias("target"))


AUGMENT = f"""
with c as (select l_partkey, l_linenumber, count(*) as n from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_partkey order by n desc, l_linenumber) as rk, count(*) over (partition by l_partkey) as k_all from c),
s as (select *, case when k_all > 3 then 2 + {h32("'k|' || l_partkey")} % 2 else 2 end as k from r where {uniform("'aug|' || l_partkey")} < 0.5 and k_all > 2),
l as (select *, row_number() over (partition by l_partkey, rk = 1 order by substr(sha1('lose|' || l_partkey || '|' || l_linenumber), 1, 16)) as lk from s),
t as (select *, n / sum(n) over (partition by l_partkey)::DOUBLE as p, substr(sha1('mix|' || l_partkey || '|' || l_linenumber), 1, 16) as h from l where rk = 1 or lk < k)
select l_partkey, k::INT as k, string_agg(l_linenumber::VARCHAR, ',' order by h) as options, string_agg(printf('%.4f', p), ',' order by h) as target from t group by 1, 2"""


def yes_rate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes-heavy parts dropped in hash order until the mean share of yes first reaches the goal."""
    bools = build.vote_spread_bool(spark, sf_dir)
    totals = bools.agg(F.sum("p_yes").alias("total"), F.count(F.lit(1)).alias("count"))
    heavy = bools.where("p_yes > 0.5").crossJoin(F.broadcast(totals))
    order = [hashing.order_key(F.lit("yes"), F.col("part_id").cast("string"))]
    dropped = integrate.prefix_until(heavy, order, F.col("p_yes"), F.col("total"), F.col("count"), 0.48)
    return dropped.select("part_id", "rn")


PREFIX = f"""
with b as ({build.VOTES}), t as (select sum(p_yes) as total, count(*) as n from b),
h as (select part_id, p_yes, row_number() over (order by substr(sha1('yes|' || part_id), 1, 16)) as rn from b where p_yes > 0.5),
m as (select *, (total - sum(p_yes) over (order by rn)) / (n - rn) as mean_after from h cross join t)
select part_id, rn from m where rn <= coalesce((select min(rn) from m where mean_after <= 0.48), rn)"""


def topic_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a cap by source, then one by opening; drops take from the densest languages first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", rules.cap_group(F.col("source"), "src1").alias("source"), F.lower(text.opening(F.col("text"), 1)).alias("opening"))
    n = docs.count()
    density = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("density"))
    kept, density = balance.capped_groups(docs, "source", "lang", "doc_id", 0.5, n, density, "topic")
    kept, _ = balance.capped_groups(kept, "opening", "lang", "doc_id", 0.03, n, density, "opening")
    return kept.select("doc_id", "source", "opening")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(hashing.order_key(F.lit("s1"), F.col("o_orderkey").cast("string"))).limit(200)


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders of each priority, in proportion to their price, without replacement."""
    return builders.weighted_pick(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_totalprice"), 5, F.lit("w"), F.col("o_orderkey").cast("string")).select("o_orderkey", "o_orderpriority", "pick")


def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each epoch's own order of the suppliers."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(spark.range(3).withColumnRenamed("id", "epoch"))
    keyed = rows.withColumn("h", hashing.order_key(F.lit("perm"), F.col("epoch").cast("string"), F.col("s_suppkey").cast("string")))
    return grouped_running(keyed, ["epoch"], ["h", "s_suppkey"], F.lit(1), "step").select("epoch", "s_suppkey", "step")


def shard_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash order, then every fourth row to one shard."""
    keyed = table(spark, sf_dir, "customer").select("c_custkey", hashing.order_key(F.lit("shard"), F.col("c_custkey").cast("string")).alias("h"))
    return numbered(keyed, ["h", "c_custkey"]).select("c_custkey", ((F.col("rn") - 1) % 4).cast("int").alias("shard"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.stratified(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], 300, F.lit("st"), F.col("o_orderkey").cast("string"))


STRATIFIED = """
with r as (select *, substr(sha1('st|' || o_orderkey), 1, 16) as h, count(*) over (partition by o_orderstatus, o_orderpriority) as own, count(*) over () as total from orders),
k as (select *, row_number() over (partition by o_orderstatus, o_orderpriority order by h) as rk from r)
select o_orderkey, o_orderstatus, o_orderpriority from k where rk <= greatest(1, round_even(300 * own / total::DOUBLE, 0)) order by h limit 300"""


def stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split, by split and language, by source, and overall in one pass."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", hashing.split_of(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("split"))
    docs.createOrReplaceTempView("quorum_split_documents")
    return spark.sql("select split, lang, source, grouping(split) * 4 + grouping(lang) * 2 + grouping(source) as level, count(*) as n from quorum_split_documents group by grouping sets ((split), (split, lang), (source), ())")


def hash_coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of 64-bit hashes, a 55 % coin and the two smallest of four alternates."""
    key = F.col("doc_id").cast("string")
    alternates = F.array(*(F.lit(x) for x in ("amber", "birch", "cedar", "delta")))
    two = F.transform(F.slice(F.array_sort(F.transform(alternates, lambda a: F.struct(hashing.order_key(key, F.lit("alt"), a).alias("h"), a.alias("a")))), 1, 2), lambda x: x["a"])
    return table(spark, sf_dir, "documents").select("doc_id", (hashing.h64(key, F.lit("half")) % 2).cast("int").alias("half"), (hashing.h64(key, F.lit("held")) % 100 < 55).alias("held"), F.array_join(two, ",").alias("alternates"), rules.cap_group(F.col("source"), "src1").alias("cap_group"))


def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return counts.orderBy(F.desc("n"), F.desc("quantity"), "l_partkey").limit(25)


WEIGHTED = "'w|' || o_orderkey"
DOC = "'doc_' || doc_id"

QUERIES = {f.__name__: f for f in (cap_per_source, option_augment, yes_rate_prefix, topic_balance, seeded_sample, weighted_sample, epoch_permutation, shard_stride, stratified_sample, stats_grouping_sets, hash_coins, top_counts)}
SQL = {
    "cap_per_source": "select doc_id, lang, rk from (select doc_id, lang, row_number() over (partition by lang order by substr(sha1('cap|' || doc_id), 1, 16)) as rk from documents) where rk <= case lang when 'en' then 300 when 'fr' then 60 when 'de' then 60 when 'es' then 200 end",
    "option_augment": AUGMENT,
    "yes_rate_prefix": PREFIX,
    "seeded_sample": "select o_orderkey from orders order by substr(sha1('s1|' || o_orderkey), 1, 16) limit 200",
    "weighted_sample": f"select o_orderkey, o_orderpriority, pick from (select *, row_number() over (partition by o_orderpriority order by -ln({uniform(WEIGHTED)}) / o_totalprice) as pick from orders) where pick <= 5",
    "epoch_permutation": "select epoch, s_suppkey, row_number() over (partition by epoch order by substr(sha1('perm|' || epoch || '|' || s_suppkey), 1, 16)) - 1 as step from supplier cross join range(3) t(epoch)",
    "shard_stride": "select c_custkey, (row_number() over (order by substr(sha1('shard|' || c_custkey), 1, 16)) - 1) % 4 as shard from customer",
    "stratified_sample": STRATIFIED,
    "stats_grouping_sets": f"select split, lang, source, grouping(split) * 4 + grouping(lang) * 2 + grouping(source) as level, count(*) as n from (select lang, source, {split_of(DOC)} as split from documents) group by grouping sets ((split), (split, lang), (source), ())",
    "hash_coins": "select doc_id, (('0x' || substr(sha1(doc_id || '|half'), 1, 16))::HUGEINT % 2)::INT as half, ('0x' || substr(sha1(doc_id || '|held'), 1, 16))::HUGEINT % 100 < 55 as held, array_to_string(list_transform(list_sort(list_transform(['amber', 'birch', 'cedar', 'delta'], lambda a: {'h': substr(sha1(doc_id || '|alt|' || a), 1, 16), 'a': a}))[1:2], lambda x: x.a), ',') as alternates, case when source like 'src1%' then 'src1' else source end as cap_group from documents",
    "top_counts": "select l_partkey, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1 order by n desc, quantity desc, l_partkey limit 25",
}
