"""Queries of recalibration: questions of three types and several numbers of letters, read in several orders from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, hashing
from ..operators import calibration, recalibration
from ..operators.calibration import SHIFTS
from .common import h32, table

#: Temperature and N/A bias of the calibration so far.
OLD = (1.5, 0.3)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, type, orders, lp, target, na, half: labels choose the answer, label 9 says that there is none."""
    kind = F.element_at(F.array(F.lit("bool"), F.lit("choice"), F.lit("score")), (F.col("vec_id") % 3 + 1).cast("int"))
    n = F.when(F.col("type") == "bool", 3).when(F.col("type") == "score", 7).otherwise(5 + (F.floor(F.col("vec_id") / 3) % 2).cast("int"))
    rows = table(spark, sf_dir, "embeddings").withColumn("type", kind).withColumn("n", n).withColumn("orders", recalibration.orders_of(F.col("type"), F.col("n")))
    raw = F.transform(F.sequence(F.lit(0), F.size("orders") - 1), lambda r: calibration.readout(F.transform(F.slice("embedding", r * F.col("n") + 1, F.col("n")), lambda v: v.cast("double") * 10.0)))
    none = F.col("label") == 9
    target = F.when(~none, dist.one_hot(F.col("n") - 1, F.col("label") % (F.col("n") - 1)))
    half = F.when(hashing.h32(F.lit("half"), F.col("vec_id").cast("string")) % 2 == 1, "fit").otherwise("eval")
    return rows.select("vec_id", "type", "orders", raw.alias("lp"), target.alias("target"), none.cast("double").alias("na"), half.alias("half"))


def letter_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biases of the letters by type and number of letters, in closed form."""
    got = recalibration.letter_biases(_questions(spark, sf_dir), "type", places=6)
    return got.select("type", "n", F.posexplode("bias").alias("pos", "bias"))


def recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation by type before and after recalibration."""
    rows = _questions(spark, sf_dir)
    old = spark.createDataFrame([(t, *OLD) for t in ("bool", "choice", "score")], "type string, t double, na_bias double")
    done = recalibration.recalibrate(rows, rows, old)
    report = done["report"].select("phase", "type", "n", *(F.round(c, 4).alias(c) for c in ("loss", "ece", "acc", "stability", "auroc")))
    return report.join(done["fitted"], "type", "left").select("phase", "type", "n", "loss", "ece", "acc", "stability", "auroc", F.when(F.col("phase") == "after", F.col("t")).alias("t"), F.when(F.col("phase") == "after", F.col("na_bias")).alias("na_bias"))


_SHIFTS = "case n " + " ".join(f"when {n} then {list(SHIFTS[n])}" for n in (3, 5, 6)) + " end"
_LP = f"""
with q as (select vec_id, label, embedding, type, case type when 'bool' then 3 when 'score' then 7 else 5 + (vec_id // 3) % 2 end::INT as n, case when {h32("'half|' || vec_id")} % 2 = 1 then 'fit' else 'eval' end as half
  from (select *, ['bool', 'choice', 'score'][vec_id % 3 + 1] as type from embeddings)),
raw as (select vec_id, type, n, rot, pos, case when type = 'score' then case rot when 0 then pos else n - 1 - pos end else (pos + ({_SHIFTS})[rot + 1]) % n end as item, embedding[rot * n + pos + 1]::DOUBLE * 10.0::DOUBLE as x from q cross join range(4) a(rot) cross join range(7) b(pos) where pos < n and rot < case when type = 'score' then 2 else n end),
lp as materialized (select *, x - (max(x) over w + ln(sum(exp(x - mx)) over w)) as lp from (select *, max(x) over (partition by vec_id, rot) as mx from raw) window w as (partition by vec_id, rot)),
c as (select *, greatest(-20.0::DOUBLE, lp) as y from lp),
x as materialized (select vec_id, type, n, item, pos, y - avg(y) over (partition by vec_id, rot) as x from c),
b0 as (select distinct type, n, pos, 0.0::DOUBLE as b from x)"""
_STEP = """,
a{k} as materialized (select vec_id, type, n, item, avg(x - b) as a from x join b{j} using (type, n, pos) group by all),
r{k} as (select type, n, pos, avg(x - a) as b from x join a{k} using (vec_id, type, n, item) group by all),
b{k} as materialized (select type, n, pos, b - avg(b) over (partition by type, n) as b from r{k})"""
_BIASES = _LP + "".join(_STEP.format(k=k, j=k - 1) for k in range(1, 26))


def _guess(name: str, rows: str, grid: str, bias: str, prior: str = "") -> str:
    """CTEs: p (mean distribution by item), na and the shares of the answers, for each question and point (type, idx, t, b) of a grid."""
    prior = f"left join {prior} pr on pr.regime = m.regime and pr.k = m.n - 1 and pr.pos = m.item and m.type = 'choice'" if prior else "cross join (select 1.0::DOUBLE as prior) pr"
    return f""",
{name}z as (select lp.vec_id, lp.type, lp.n, rot, item, idx, exp((lp - coalesce(l.b, 0)) / t + case when item = lp.n - 1 then g.b else 0 end) as z from lp join ({rows}) using (vec_id) join {grid} g on g.type = lp.type left join {bias} l on l.type = lp.type and l.n = lp.n and l.pos = lp.pos),
{name}p as (select vec_id, type, n, idx, rot, item, z / sum(z) over (partition by vec_id, idx, rot) as p from {name}z),
{name}d as (select vec_id, type, n, idx, item, avg(p) as p from {name}p group by all),
{name}n as (select *, max(case when item = n - 1 then p end) over (partition by vec_id, idx) as na from {name}d),
{name}m as (select *, case when na >= 0.5 then 'na' else 'answerable' end as regime from {name}n where item < n - 1),
{name}r as (select m.vec_id, m.type, m.n, idx, item, na, m.regime, p / coalesce(prior, 1) as v from {name}m m {prior}),
{name}t as materialized (select *, v / sum(v) over (partition by vec_id, idx) as share from {name}r),
{name}l as materialized (select vec_id, t.type, t.n, idx, any_value(na) as na, max(share) as conf, arg_max(item, share) as top, any_value(label) as label,
  case when any_value(label) = 9 then -ln(greatest(any_value(na), 1e-9::DOUBLE)) else -ln(greatest(1 - any_value(na), 1e-9::DOUBLE)) - ln(greatest(max(case when item = label % (t.n - 1) then share end), 1e-9::DOUBLE)) end as loss
  from {name}t t join q using (vec_id) group by vec_id, t.type, t.n, idx)"""


def _best(name: str, key: str, source: str) -> str:
    return f""",
{name} as materialized (select type, arg_min({key}, (l, idx)) as {key} from (select s.type, s.idx, g.{key}, round(avg(loss), 9) as l from {source}l s join {source}g g using (type, idx) group by all) group by type)"""


def _report(name: str, phase: str, tail: str) -> str:
    return f"""
select '{phase}' as phase, s.type, n, round(loss, 4) as loss, round(ece, 4) as ece, round(acc, 4) as acc, round(stability, 4) as stability, null::DOUBLE as auroc, {tail} from
  (select type, count(*) as n, avg(loss) as loss from {name}l group by 1) s
  left join (select type, avg(case when top = label % (n - 1) then 1.0::DOUBLE else 0 end) as acc from {name}l where label <> 9 group by 1) using (type)
  left join (select type, sum(abs(c - a)) / sum(m) as ece from (select type, least(floor(conf * 15), 14) as bin, count(*) as m, sum(conf) as c, sum(case when top = label % (n - 1) then 1.0::DOUBLE else 0 end) as a from {name}l where label <> 9 group by 1, 2) group by 1) using (type)
  left join (select type, list_sort(list(js))[(floor(0.95 * count(*)) + 1)::INT] as stability from (select vec_id, type, max(js) as js from (select vec_id, p.type, rot, sum(p.p * ln(p.p / ((p.p + d.p) / 2)) + d.p * ln(d.p / ((p.p + d.p) / 2))) / 2 as js from {name}p p join {name}d d using (vec_id, item) group by all) group by 1, 2) group by 1) using (type)
  left join fitted f on f.type = s.type
union all select '{phase}', 'na', count(*) filter (y), null, null, null, null, round((sum(rk) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / nullif(count(*) filter (y) * count(*) filter (not y), 0), 4), null, null
  from (select y, avg(rn) over (partition by na) as rk from (select label = 9 as y, na, row_number() over (order by na) as rn from {name}l))"""


_GRID_T = "select type, i as idx, round(0.3::DOUBLE * pow(1.1::DOUBLE, i), 4) as t, {b} as b from {source} cross join range(48) g(i)"
RECALIBRATED = (
    _BIASES
    + ",\nnone as (select * from b25 where false), lb as materialized (select type, n, pos, round(b, 4) as b from b25 where type <> 'bool'), types as (select distinct type from q)"
    + f",\ns1_g as ({_GRID_T.format(b='0.0::DOUBLE', source='types')})" + _guess("s1_", "select vec_id from q where half = 'fit'", "s1_g", "lb") + _best("one", "t", "s1_")
    + ",\ns2_g as (select type, i as idx, t, i / 4.0::DOUBLE - 4 as b from one cross join range(33) g(i))" + _guess("s2_", "select vec_id from q where half = 'fit'", "s2_g", "lb") + _best("two_", "b", "s2_")
    + ",\ntwo as (select type, case when exists (select 1 from q where q.type = two_.type and half = 'fit' and label = 9) then b else 0 end as b from two_)"
    + f",\ns3_g as (select type, idx, t, b from ({_GRID_T.format(b='b', source='two')}))" + _guess("s3_", "select vec_id from q where half = 'fit'", "s3_g", "lb") + _best("three", "t", "s3_")
    + ",\nfitted as materialized (select type, 0 as idx, t, b from three join two using (type))"
    + _guess("s4_", "select vec_id from q where type = 'choice'", "fitted", "lb")
    + ",\nprior as materialized (select regime, n - 1 as k, item as pos, round(avg(share), 5) as prior from s4_t group by all)"
    + f",\nold as (select type, 0 as idx, {OLD[0]}::DOUBLE as t, {OLD[1]}::DOUBLE as b from types)"
    + _guess("s5_", "select vec_id from q where half = 'eval'", "old", "none") + _guess("s6_", "select vec_id from q where half = 'eval'", "fitted", "lb", "prior")
    + _report("s5_", "before", "null::DOUBLE as t, null::DOUBLE as na_bias") + "\nunion all" + _report("s6_", "after", "t, b as na_bias")
)

QUERIES = {f.__name__: f for f in (letter_biases, recalibrated)}
SQL = {"letter_biases": _BIASES + " select type, n, pos, round(b, 6) as bias from b25", "recalibrated": RECALIBRATED}
