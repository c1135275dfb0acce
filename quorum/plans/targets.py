"""Queries from readouts to final questions: targets by prior, losses with N/A, finalised and augmented sets, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, hashing, rules, targets, text
from ..operators import builders, calibration
from . import build, calibrate, select
from .common import h32, table

BIAS = (0.2, 0.1, 0.0, -0.1, -0.2)


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the distribution over four answers and N/A."""
    lp = calibration.readout(F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double") * 10.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", targets.calibrated(lp, F.array(*(F.lit(b) for b in BIAS)), 1.5, 0.3).alias("p"))


def answer_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and N/A share of each question, divided by the prior of the positions in its regime."""
    rows = _calibrated(spark, sf_dir).withColumn("regime", targets.regime(F.element_at("p", -1)))
    own = rows.select("regime", F.posexplode(dist.normalised(targets.answer_part(F.col("p")))).alias("pos", "q"))
    mean = own.groupBy("regime", "pos").agg(F.round(F.avg("q"), 5).alias("prior"))
    priors = mean.groupBy("regime").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prior"))), lambda x: x["prior"]).alias("prior"))
    made = rows.join(F.broadcast(priors), "regime", "left").select("vec_id", targets.target_of(F.col("p"), F.col("prior")).alias("x"))  # two rows at most
    return made.select("vec_id", F.round("x.na", 6).alias("na"), *(F.round(F.element_at("x.target", k + 1), 6).alias(f"t{k}") for k in range(4)))


_C = """
with x as (select vec_id, label, p as pos, (embedding[p + 1]::DOUBLE * 10.0::DOUBLE - [0.2, 0.1, 0.0, -0.1, -0.2][p + 1]::DOUBLE) / 1.5::DOUBLE + case when p = 4 then 0.3::DOUBLE else 0 end as l from embeddings cross join range(5) t(p)),
e as (select *, exp(l - max(l) over (partition by vec_id)) as e from x), c as (select vec_id, label, pos, e / sum(e) over (partition by vec_id) as p from e),
n as (select vec_id, max(case when pos = 4 then p end) as na from c group by 1),
r as (select c.vec_id, c.label, c.pos, p / sum(p) over (partition by c.vec_id) as q, na, case when na >= 0.5 then 'na' else 'answerable' end as regime from c join n using (vec_id) where c.pos < 4)"""
ANSWER = f"""{_C},
pr as (select regime, pos, round(avg(q), 5) as prior from r group by 1, 2), d as (select vec_id, r.pos, na, q / prior as v from r join pr using (regime, pos)),
t as (select vec_id, pos, na, v / sum(v) over (partition by vec_id) as t from d)
select vec_id, round(max(na), 6) as na, round(max(t) filter (pos = 0), 6) as t0, round(max(t) filter (pos = 1), 6) as t1, round(max(t) filter (pos = 2), 6) as t2, round(max(t) filter (pos = 3), 6) as t3 from t group by 1"""


def combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of N/A and of the answers together (F12); questions with a label beyond the four answers have none."""
    rows = _calibrated(spark, sf_dir)
    known = F.col("label").between(0, 3)
    true = F.when(known, dist.one_hot(4, F.col("label")))
    guess = targets.target_of(F.col("p"))
    return rows.withColumn("g", guess).select("vec_id", F.round(targets.loss(true, F.when(known, 0.0).otherwise(1.0), F.col("g.target"), F.col("g.na")), 6).alias("loss"))


COMBINED = f"""{_C}
select vec_id, round(case when any_value(label) between 0 and 3 then -ln(greatest(1 - max(na), 1e-9::DOUBLE)) - ln(greatest(max(q) filter (pos = label), 1e-9::DOUBLE)) else -ln(greatest(max(na), 1e-9::DOUBLE)) end, 6) as loss from r group by 1"""


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable questions with targets from their mean distribution, nested by label in the order of their ids."""
    stable = calibrate.aggregated(spark, sf_dir).where("stability <= 0.2").select("vec_id", targets.target_of(F.col("dist")).alias("x"))
    rows = stable.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").where(F.col("x.target").isNotNull())
    best = dist.argmax(F.transform("x.target", lambda v: F.round(v, 9)))
    nested = F.array_sort(F.collect_list(F.struct("vec_id", best.alias("best"), F.round("x.na", 6).alias("na"))))
    done = rows.groupBy(F.col("label").alias("image")).agg(nested.alias("questions"))
    return done.select("image", F.size("questions").alias("n"), F.round(F.aggregate("questions", F.lit(0.0), lambda a, q: a + q["na"]), 4).alias("na"), F.md5(F.array_join(F.transform("questions", lambda q: F.concat_ws(":", q["vec_id"].cast("string"), q["best"].cast("string"))), ",")).alias("digest"))


FINAL = (
    calibrate.CALIBRATED.rsplit("select vec_id, round(stability", 1)[0]
    + """, f as (select vec_id, label, round(dist[5], 6) as na, list_transform(dist[1:4], lambda v: round(v / list_sum(dist[1:4]), 9)) as t from d join s using (vec_id) join embeddings using (vec_id) where stability <= 0.2)
select label as image, count(*)::INT as n, round(sum(na), 4) as na, md5(string_agg(vec_id || ':' || (list_position(t, list_max(t)) - 1), ',' order by vec_id)) as digest from f group by 1"""
)


def augmented_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals and, below their ids, the augmented copies with a mark."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("o"), F.col("n").cast("double").alias("n")))).alias("x"))
    p = dist.normalised(F.transform("x", lambda e: e["n"]))
    own = nested.select("l_partkey", F.size("x").alias("k"), F.array_join(F.transform("x", lambda e: e["o"].cast("string")), ",").alias("options"), dist.shown(p, 9).alias("target"), F.lit(False).alias("aug"))
    return own.unionByName(select.option_augment(spark, sf_dir).withColumn("aug", F.lit(True)))


UNION = f"""
select l_partkey, count(*)::INT as k, string_agg(l_linenumber::VARCHAR, ',' order by l_linenumber) as options, string_agg(printf('%.9f', p), ',' order by l_linenumber) as target, false as aug
from (select l_partkey, l_linenumber, n / sum(n) over (partition by l_partkey)::DOUBLE as p from (select l_partkey, l_linenumber, count(*) as n from lineitem group by 1, 2)) group by 1
union all select *, true from ({select.AUGMENT})"""


def absent_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a question about a kind that it lacks: no target, N/A one."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lacking = builders.absent_items(lines, "l_orderkey", "p_type")
    item = hashing.pick(F.array_sort("absent"), F.concat(F.lit("na|"), F.col("l_orderkey").cast("string")))
    thing = F.lower(item)
    question = F.concat(text.capitalised(text.agreement(thing)), F.lit(" the "), thing, F.lit(" blue?"))
    return lacking.where(F.size("absent") > 0).select("l_orderkey", question.alias("q"), F.lit(None).cast("double").alias("target"), F.lit(1.0).alias("na"))


ABSENT = f"""{build._L},
a as (select l_orderkey, list(p_type order by p_type) as items from (select o.l_orderkey, t.p_type from (select distinct l_orderkey from m) o cross join (select distinct p_type from m) t anti join m on m.l_orderkey = o.l_orderkey and m.p_type = t.p_type) group by 1),
i as (select l_orderkey, lower(items[{h32("'na|' || l_orderkey")} % len(items) + 1]) as item from a)
select l_orderkey, case when item like '%s' and not regexp_matches(item, '(ss|us|is)$') then 'Are' else 'Is' end || ' the ' || item || ' blue?' as q, null::DOUBLE as target, 1.0::DOUBLE as na from i"""


def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason why a request is refused, and the anchors of an accepted scale, over requests made of parts."""
    i, n = F.col("p_partkey"), F.col("p_name")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("bool", "choice", "score", "rank"))), (i % 4 + 1).cast("int"))
    blank = F.when(i % 3 == 0, F.lit("  ")).otherwise(n)
    options = F.when(i % 5 == 0, F.array(n, F.concat(F.lit(" "), F.upper(n)))).when(i % 7 == 0, F.array(n, blank)).when(i % 11 == 0, F.array(n, F.repeat(n, 9))).otherwise(F.array(n, F.col("p_brand"), F.lit("")))
    q = F.when(i % 13 == 0, " ").when(i % 17 == 0, F.repeat(n, 40)).otherwise(n)
    low, high = (i % 6).cast("int") - 1, (i % 12).cast("int")
    anchors = F.when(i % 8 == 2, F.array(F.lit(" bad "), F.repeat(n, 9))).otherwise(F.array(n, F.lit(" ")))
    reason = rules.request_problem(kind, q, options, low, high)
    kept = F.when(reason.isNull() & (kind == "score"), F.array_join(rules.anchors_or_ends(anchors, low, high), "/"))
    return table(spark, sf_dir, "part").select(i, reason.alias("reason"), kept.alias("anchors"))


REQUESTS = """
with p as (select p_partkey as i, p_name as n, p_brand as b, p_partkey % 6 - 1 as lo, p_partkey % 12 as hi from part),
o as (select *, case when i % 5 = 0 then [n, ' ' || upper(n)] when i % 7 = 0 then [n, case when i % 3 = 0 then '  ' else n end] when i % 11 = 0 then [n, repeat(n, 9)] else [n, b, ''] end as given,
  trim(case when i % 13 = 0 then ' ' when i % 17 = 0 then repeat(n, 40) else n end) as q from p),
g as (select *, list_filter(list_transform(given, lambda x: trim(x)), lambda x: x <> '') as opts from o),
r as (select *, case when i % 4 = 3 then 'type' when length(q) not between 1 and 300 then 'text'
  when i % 4 = 1 and not (len(opts) between 2 and 8 and len(list_distinct(list_transform(opts, lambda x: lower(x)))) = len(opts) and list_max(list_transform(opts, lambda x: length(x))) <= 60) then 'options'
  when i % 4 = 2 and not (lo >= 0 and lo < hi and hi <= 10) then 'scale' end as reason from g)
select i as p_partkey, reason, case when reason is null and i % 4 = 2 then case when i % 8 = 2 then 'bad/' || substr(repeat(n, 9), 1, 40) else lo || '/' || hi end end as anchors from r"""

QUERIES = {f.__name__: f for f in (answer_target, combined_loss, finalized, augmented_union, absent_questions, request_rules)}
SQL = {"answer_target": ANSWER, "combined_loss": COMBINED, "finalized": FINAL, "augmented_union": UNION, "absent_questions": ABSENT, "request_rules": REQUESTS}
