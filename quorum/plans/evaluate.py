"""Queries of evaluation: calibration error, ranking, grouped losses, ranks, question losses, shown distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist, rules
from ..operators import metrics
from . import build
from .common import split_of, table

SCALE = 10.0


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-way questions with the softmax of the first ten components, confidence, soft accuracy and loss."""
    p = dist.softmax(F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * SCALE))
    rows = table(spark, sf_dir, "embeddings").where("label between 0 and 9").select("vec_id", "label", p.alias("p"))
    return rows.withColumn("t", dist.one_hot(10, F.col("label"))).select("vec_id", "label", F.array_max("p").alias("conf"), dist.soft_accuracy(F.col("t"), F.col("p")).alias("acc"), dist.nll(F.col("t"), F.col("p")).alias("nll"))


SCORED = """
with x as (select vec_id, label, k, embedding[k + 1]::DOUBLE * 10.0::DOUBLE as x from embeddings cross join range(10) r(k) where label between 0 and 9),
m as (select *, max(x) over (partition by vec_id) as mx from x),
p as (select *, exp(x - mx) / sum(exp(x - mx)) over (partition by vec_id) as p from m),
scored as (select vec_id, label, max(p) as conf, case when arg_max(k, (x, -k)) = label then 1.0::DOUBLE else 0.0::DOUBLE end as acc, -ln(greatest(max(case when k = label then p end), 1e-12::DOUBLE)) as nll from p group by 1, 2)"""


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("half", F.col("vec_id") % 2)
    return metrics.ece(rows, F.col("conf"), F.col("acc"), "half").select("half", F.round("ece", 6).alias("ece"), "n")


def auroc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the length ranks good documents, by language; lengths in tens, so that there are ties."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.auroc(rows, F.floor(F.col("n_chars") / 10), F.col("quality") == 1, "lang").select("lang", F.round("auroc", 6).alias("auroc"), "positives")


AUROC = """
with d as (select lang, n_chars // 10 as s, quality from documents join labels using (doc_id)),
r as (select *, avg(rn) over (partition by lang, s) as rk from (select *, row_number() over (partition by lang order by s) as rn from d))
select lang, round((sum(rk) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2.0) / nullif(count(*) filter (quality = 1) * count(*) filter (quality <> 1), 0), 6) as auroc, count(*) filter (quality = 1) as positives from r group by 1"""


def nll_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("acc"), 6).alias("acc"))


def metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row counts in several groups: overall, its label's parity, and the held-out one."""
    parity = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    held = F.when(F.col("label") == 9, "held_out/nine")
    rows = metrics.in_groups(_scored(spark, sf_dir), F.array(F.lit("all"), F.concat(F.lit("label/"), parity), held))
    means = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("acc"), 4).alias("acc"), F.round(F.avg("nll"), 4).alias("nll"))
    return means.join(metrics.ece(rows, F.col("conf"), F.col("acc"), "grp").select("grp", F.round("ece", 4).alias("ece")), "grp")


_GROUPS = """, g as (select *, unnest(list_filter(['all', 'label/' || case when label % 2 = 0 then 'even' else 'odd' end, case when label = 9 then 'held_out/nine' end], lambda x: x is not null)) as grp from scored)"""
_ECE = "(select {by}, sum(abs(c - a)) / sum(n) as e, sum(n)::BIGINT as n from (select {by}, least(floor(conf * 15), 14) as b, count(*) as n, sum(conf) as c, sum(acc) as a from {f} group by 1, 2) group by 1)"


def p95_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_value(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", 0.95, "o_orderpriority")


def question_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of each supplier's quantity histogram against that of all suppliers: cross entropy, ranked score, BCE."""
    h = build.vote_histogram_score(spark, sf_dir).withColumn("t", F.array(*(f"p{k}" for k in range(1, 6))))
    mean = h.agg(*(F.round(F.avg(f"p{k}"), 6).alias(f"m{k}") for k in range(1, 6)))
    rows = h.crossJoin(F.broadcast(mean)).withColumn("p", F.array(*(f"m{k}" for k in range(1, 6))))
    t, p = F.col("t"), F.col("p")
    return rows.select("supp_id", F.round(dist.nll(t, p, 1e-9), 6).alias("ce"), F.round(dist.ranked_probability_score(t, p), 6).alias("rps"), F.round(dist.entropy_bernoulli_loss(F.col("p1"), F.col("m1")), 6).alias("bce"))


_T = [f"p{k}" for k in range(1, 6)]
LOSS = (
    f"with h as ({build.HISTOGRAM}), m as (select "
    + ", ".join(f"round(avg(p{k}), 6) as m{k}" for k in range(1, 6))
    + " from h) select supp_id, round(-("
    + " + ".join(f"p{k} * ln(greatest(m{k}, 1e-9::DOUBLE))" for k in range(1, 6))
    + "), 6) as ce, round(("
    + " + ".join("pow(" + " + ".join(f"p{j}" for j in range(1, k + 1)) + " - (" + " + ".join(f"m{j}" for j in range(1, k + 1)) + "), 2)" for k in range(1, 5))
    + ") / 4, 6) as rps, round(-(p1 * ln(m1 + 1e-9::DOUBLE) + (1 - p1) * ln(1 - m1 + 1e-9::DOUBLE)), 6) as bce from h cross join m"
)


def display_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a part's yes/no question as text, and its flags."""
    b = build.vote_spread_bool(spark, sf_dir)
    flags = rules.flags(close=F.abs(F.col("p_yes") - 0.5) < 0.1, few=F.col("n_yes") + F.col("n_no") < 15, yes=F.col("p_yes") > 0.5)
    return b.select("part_id", rules.shown(F.array(F.lit("no"), F.lit("yes")), F.array("p_no", "p_yes")).alias("shown"), F.array_join(flags, ",").alias("flags"))


DISPLAY = f"""
with b as ({build.VOTES})
select part_id, array_to_string(list_filter(case when p_no >= p_yes then [case when p_no >= 0.01 then 'no ' || round(p_no * 100)::INT || '%' end, case when p_yes >= 0.01 then 'yes ' || round(p_yes * 100)::INT || '%' end] else [case when p_yes >= 0.01 then 'yes ' || round(p_yes * 100)::INT || '%' end, case when p_no >= 0.01 then 'no ' || round(p_no * 100)::INT || '%' end] end, lambda x: x is not null), ', ') as shown,
  array_to_string(list_filter([case when abs(p_yes - 0.5) < 0.1 then 'close' end, case when n_yes + n_no < 15 then 'few' end, case when p_yes > 0.5 then 'yes' end], lambda x: x is not null), ',') as flags from b"""


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by type from the options of a part, sorted, with the number of new questions and a JSON schema."""
    c = build.vote_spread_choice(spark, sf_dir)
    options = F.array_sort(F.split("options", ","))
    letters = F.array(*(F.lit(x) for x in "ABCDEFGH"))
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.element_at(letters, i + 1), F.lit(") "), o)), "\n")
    new = F.greatest(F.lit(1), F.least(F.lit(4), 5 - (F.col("mode_n") % 7).cast("int")))
    schema = F.to_json(F.named_struct(F.lit("type"), F.lit("choice"), F.lit("k"), F.size(options)))
    return c.select("part_id", F.concat(F.lit("Pick one:\n"), lines).alias("prompt"), new.alias("new_questions"), schema.alias("schema"))


PROMPT = f"""
with c as ({build.CHOICE}), s as (select *, list_sort(string_split(options, ',')) as o from c)
select part_id, 'Pick one:' || chr(10) || array_to_string(list_transform(o, lambda x, i: ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][i] || ') ' || x), chr(10)) as prompt,
  greatest(1, least(4, 5 - (mode_n % 7)))::INT as new_questions, '{{"type":"choice","k":' || len(o) || '}}' as schema from s"""


def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of the last eighty lines of each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").rowsBetween(-79, 0)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).over(w) / F.count(F.lit(1)).over(w), 4).alias("mean80"))


def scalar_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up and cosine, grid positions and back-off delays by step."""
    s = F.col("id")
    rate = F.when(s < 50, (s + 1) / 50.0).otherwise(0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * (s - 50) / 450.0)))
    return spark.range(500).select(s.alias("step"), F.round(rate, 9).alias("rate"), F.floor(s / 24).alias("row"), (s % 24).alias("col"), (2 * F.pow(F.lit(2.0), s % 4)).alias("delay"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.hashing import split_of as split

    b = build.vote_spread_bool(spark, sf_dir)
    return b.groupBy(split(F.concat(F.lit("p_"), F.col("part_id").cast("string"))).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_yes"), 6).alias("mean_p_yes"))


PART = "'p_' || part_id"
QUERIES = {f.__name__: f for f in (ece_bins, auroc_ties, nll_by_group, metric_groups, p95_rank, question_loss, display_dist, prompt_text, trailing_mean, scalar_schedules, split_counts)}
SQL = {
    "ece_bins": SCORED + f", h as (select *, vec_id % 2 as half from scored) select half, round(e, 6) as ece, n from {_ECE.format(by='half', f='h')}",
    "auroc_ties": AUROC,
    "nll_by_group": SCORED + " select label, count(*) as n, round(avg(nll), 6) as nll, round(avg(acc), 6) as acc from scored group by 1",
    "metric_groups": SCORED + _GROUPS + f" select grp, count(*) as n, round(avg(acc), 4) as acc, round(avg(nll), 4) as nll, round(any_value(e.e), 4) as ece from g join {_ECE.format(by='grp', f='g')} e using (grp) group by 1",
    "p95_rank": "select o_orderpriority, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice) as rn, count(*) over (partition by o_orderpriority) as n from orders) where rn = floor(n * 0.95::DOUBLE) + 1",
    "question_loss": LOSS,
    "display_dist": DISPLAY,
    "prompt_text": PROMPT,
    "trailing_mean": "select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(sum(round(l_extendedprice * 100)::BIGINT) over w / (count(*) over w)::DOUBLE, 4) as mean80 from lineitem window w as (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_extendedprice rows between 79 preceding and current row)",
    "scalar_schedules": "select s as step, round(case when s < 50 then (s + 1) / 50.0::DOUBLE else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 50) / 450.0::DOUBLE)) end, 9) as rate, s // 24 as row, s % 24 as col, 2 * pow(2.0::DOUBLE, s % 4) as delay from range(500) t(s)",
    "split_counts": f"select {split_of(PART)} as split, count(*) as n, round(avg(p_yes), 6) as mean_p_yes from ({build.VOTES}) group by 1",
}
