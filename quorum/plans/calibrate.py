"""Queries of calibration: rotations, biases, priors, fits. Raw letter scores are slices of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, hashing
from ..operators import calibration, metrics
from .common import h32, table

N, ROTATIONS, SCALE = 5, 4, 10.0


def _scores() -> list:
    return [F.transform(F.slice("embedding", r * N + 1, N), lambda v: v.cast("double") * SCALE) for r in range(ROTATIONS)]


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-letter questions read in four rotations, in the long form."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(calibration.readout(s) for s in _scores())).alias("lp"))
    return calibration.long_readout(rows, "vec_id", "lp", N)


LONG = f"""
with raw as (select vec_id, r as rot, p as pos, (p + [0, 1, 2, 4][r + 1]) % 5 as item, embedding[r * 5 + p + 1]::DOUBLE * 10.0::DOUBLE as x from embeddings cross join range(4) a(r) cross join range(5) b(p)),
long as (select vec_id, rot, pos, item, x - (max(x) over w + ln(sum(exp(x - mx)) over w)) as lp from (select *, max(x) over (partition by vec_id, rot) as mx from raw) window w as (partition by vec_id, rot))"""


def rotation_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("vec_id", "rot", "pos", "item", F.round("lp", 6).alias("lp"))


def calibrated_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter biases removed, temperature applied, rotations averaged; stable questions only."""
    done = aggregated(spark, sf_dir).where("stability <= 0.2")
    return done.select("vec_id", F.round("stability", 6).alias("stability"), F.round(F.element_at("dist", 1), 6).alias("p0"), F.round(F.element_at("dist", 5), 6).alias("p4"), dist.argmax(F.transform("dist", lambda v: F.round(v, 9))).alias("top"))


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, dist, stability of the five-letter questions."""
    bias = F.array(*(F.lit(b) for b in (0.2, 0.1, 0.0, -0.1, -0.2)))
    parts = [F.zip_with(calibration.readout(s), bias, lambda x, b: (x - b) / 1.5) for s in _scores()]
    return calibration.aggregate_rotations(table(spark, sf_dir, "embeddings"), "vec_id", [dist.softmax(z) for z in parts], N)


CALIBRATED = f"""{LONG},
z as (select *, exp((lp - [0.2, 0.1, 0.0, -0.1, -0.2][pos + 1]) / 1.5) as z from long),
p as (select vec_id, rot, item, z / sum(z) over (partition by vec_id, rot) as p from z),
m as (select vec_id, item, avg(p) as m from p group by 1, 2),
j as (select vec_id, rot, sum(p * ln(p / ((p + m) / 2)) + m * ln(m / ((p + m) / 2))) / 2 as js from p join m using (vec_id, item) group by 1, 2),
s as (select vec_id, max(js) as stability from j group by 1),
d as (select vec_id, list(m order by item) as dist from m group by 1)
select vec_id, round(stability, 6) as stability, round(dist[1], 6) as p0, round(dist[5], 6) as p4, (list_position(list_transform(dist, lambda v: round(v, 9)), list_max(list_transform(dist, lambda v: round(v, 9)))) - 1)::INT as top
from d join s using (vec_id) where stability <= 0.2"""


def letter_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter biases after three alternating steps (the library's default is 25; the SQL unrolls three)."""
    return calibration.letter_bias(_long(spark, sf_dir), "vec_id", steps=3).select("pos", F.round("bias", 6).alias("bias"))


_STEP = """
a{k} as (select vec_id, item, avg(x - b) as a from x join b{j} using (pos) group by 1, 2),
b{k} as (select pos, avg(x - a) as b from x join a{k} using (vec_id, item) group by 1)"""
BIAS = f"""{LONG},
c as (select vec_id, rot, pos, item, greatest(-20.0::DOUBLE, lp) as y from long),
x as (select vec_id, item, pos, y - avg(y) over (partition by vec_id, rot) as x from c),
b0 as (select pos, 0.0::DOUBLE as b from range(5) t(pos)),{",".join(_STEP.format(k=k, j=k - 1) for k in (1, 2, 3))}
select pos, round(b - avg(b) over (), 6) as bias from b3"""


def index_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability by option position for answerable questions and such with a large N/A share."""
    p = dist.softmax(F.transform(F.slice("embedding", 1, N), lambda v: v.cast("double") * SCALE))
    regime = F.when(F.element_at("embedding", 64) >= 0.1, "na").otherwise("answerable")
    rows = table(spark, sf_dir, "embeddings").select(regime.alias("regime"), F.posexplode(p).alias("pos", "p"))
    return rows.groupBy("regime", "pos").agg(F.round(F.avg("p"), 5).alias("prior"), F.count(F.lit(1)).alias("n"))


PRIOR = """
with r as (select vec_id, case when embedding[64] >= 0.1::FLOAT then 'na' else 'answerable' end as regime, p as pos, embedding[p + 1]::DOUBLE * 10.0::DOUBLE as x from embeddings cross join range(5) t(p)),
m as (select *, max(x) over (partition by vec_id) as mx from r), e as (select *, exp(x - mx) as e from m)
select regime, pos, round(avg(p), 5) as prior, count(*) as n from (select regime, pos, e / sum(e) over (partition by vec_id) as p from e) group by 1, 2"""


def position_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each position wins in each rotation, positions that never win included."""
    top = _long(spark, sf_dir).groupBy("vec_id", "rot").agg(F.max_by("pos", F.struct(F.round("lp", 9), -F.col("pos"))).alias("pos"))
    counts = top.groupBy("rot", "pos").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(ROTATIONS).withColumnRenamed("id", "rot").crossJoin(spark.range(N + 1).withColumnRenamed("id", "pos"))
    return every.join(F.broadcast(counts), ["rot", "pos"], "left").select("rot", "pos", F.coalesce("n", F.lit(0)).alias("n"))


POSITIONS = f"""{LONG}, t as (select vec_id, rot, arg_max(pos, (round(lp, 9), -pos)) as pos from long group by 1, 2)
select a.rot, b.pos, count(t.vec_id) as n from range(4) a(rot) cross join range(6) b(pos) left join t on t.rot = a.rot and t.pos = b.pos group by 1, 2"""


def fit_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature with the least mean loss of the label, by parity of the id, over 81 grid points (M6)."""
    grid = spark.range(81).select(F.col("id").alias("idx"), F.exp((F.col("id") - 40) / 20.0).alias("t"))
    rows = table(spark, sf_dir, "embeddings").where("label between 0 and 9").select((F.col("vec_id") % 2).alias("half"), "label", F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * SCALE).alias("x"))
    loss = -F.log(F.greatest(dist.at(dist.softmax(F.col("x"), F.col("t")), F.col("label")), F.lit(1e-12)))
    fitted = metrics.grid_fit(rows, grid, loss, ["half"], ["t"])
    return fitted.select("half", F.round("t", 6).alias("t"), F.round("loss", 6).alias("loss"))


FIT = """
with g as (select i as idx, exp((i - 40) / 20.0::DOUBLE) as t from range(81) r(i)),
x as (select vec_id, vec_id % 2 as half, label, k, embedding[k + 1]::DOUBLE * 10.0::DOUBLE as x from embeddings cross join range(10) r(k) where label between 0 and 9),
m as (select *, max(x) over (partition by vec_id) as mx from x),
e as (select vec_id, half, idx, t, sum(exp((x - mx) / t)) as s, max(case when k = label then exp((x - mx) / t) end) as own from m cross join g group by 1, 2, 3, 4),
l as (select half, idx, t, round(avg(-ln(greatest(own / s, 1e-12::DOUBLE))), 9) as loss from e group by 1, 2, 3)
select half, round(arg_min(t, (loss, idx)), 6) as t, round(min(loss), 6) as loss from l group by 1"""


def fit_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, then bias given it, then temperature again: three grid passes, the first minimum wins (M5)."""
    x = F.element_at("embedding", 1).cast("double") * SCALE
    rows = table(spark, sf_dir, "embeddings").select(F.lit("bool").alias("type"), x.alias("x"), F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("y"))
    ts = spark.range(48).select(F.col("id").alias("idx"), (0.3 * F.pow(F.lit(1.1), F.col("id"))).alias("t"))
    bs = spark.range(33).select(F.col("id").alias("idx"), (-4 + F.col("id") * 0.25).alias("b"))
    loss = lambda t, b: dist.entropy_bernoulli_loss(F.col("y"), 1 / (1 + F.exp(-(F.col("x") + b) / t)))
    one = metrics.grid_fit(rows, ts, loss(F.col("t"), F.lit(0.0)), ["type"], ["t"]).select("type", F.col("t").alias("t1"))
    two = metrics.grid_fit(rows.join(F.broadcast(one), "type"), bs, loss(F.col("t1"), F.col("b")), ["type"], ["b"]).select("type", "b")
    three = metrics.grid_fit(rows.join(F.broadcast(two), "type").withColumnRenamed("b", "b2"), ts, loss(F.col("t"), F.col("b2")), ["type"], ["t"])
    return three.join(two, "type").select("type", F.round("t", 6).alias("t"), "b", F.round("loss", 6).alias("loss"))


def _bernoulli(t: str, b: str) -> str:
    p = f"(1 / (1 + exp(-(x + {b}) / {t})))"
    return f"round(avg(-(y * ln({p} + 1e-9::DOUBLE) + (1 - y) * ln(1 - {p} + 1e-9::DOUBLE))), 9)"


TWO_WAY = f"""
with r as (select embedding[1]::DOUBLE * 10.0::DOUBLE as x, case when label >= 5 then 1.0::DOUBLE else 0.0::DOUBLE end as y from embeddings),
ts as (select i, 0.3::DOUBLE * pow(1.1::DOUBLE, i) as t from range(48) g(i)), bs as (select i, -4 + i * 0.25::DOUBLE as b from range(33) g(i)),
one as (select arg_min(t, (l, i)) as t1 from (select i, t, {_bernoulli("t", "0")} as l from r cross join ts group by 1, 2)),
two as (select arg_min(b, (l, i)) as b from (select i, bs.b, {_bernoulli("t1", "bs.b")} as l from r cross join bs cross join one group by 1, 2)),
three as (select arg_min(t, (l, i)) as t, min(l) as loss from (select i, t, {_bernoulli("t", "two.b")} as l from r cross join ts cross join two group by 1, 2))
select 'bool' as type, round(t, 6) as t, b, round(loss, 6) as loss from three cross join two"""


def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by source in hash order, and halves by the parity of the hash (M8)."""
    key = F.col("doc_id").cast("string")
    from ..operators.integrate import bottom_k

    return bottom_k(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 12, F.lit("calib"), key).select("doc_id", "source", F.when(hashing.h32(F.lit("half"), key) % 2 == 0, "fit").otherwise("eval").alias("half"))


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wording (temperature here) with the least summed loss (M9)."""
    rows = table(spark, sf_dir, "embeddings").where("label between 0 and 9").select("label", F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * SCALE).alias("x"))
    variants = spark.createDataFrame([("plain", 1.0), ("soft", 3.0), ("sharp", 0.5)], "variant string, t double")
    loss = -F.log(F.greatest(dist.at(dist.softmax(F.col("x"), F.col("t")), F.col("label")), F.lit(1e-12)))
    sums = rows.crossJoin(F.broadcast(variants)).groupBy("variant").agg(F.round(F.sum(loss), 4).alias("loss"))
    return sums.agg(F.min_by("variant", "loss").alias("variant"), F.min("loss").alias("loss"))


QUERIES = {f.__name__: f for f in (rotation_readout, calibrated_aggregate, letter_bias, index_prior, position_share, fit_temperature, fit_two_way, calibration_sample, best_variant)}
SQL = {
    "rotation_readout": LONG + " select vec_id, rot, pos, item, round(lp, 6) as lp from long",
    "calibrated_aggregate": CALIBRATED,
    "letter_bias": BIAS,
    "index_prior": PRIOR,
    "position_share": POSITIONS,
    "fit_temperature": FIT,
    "fit_two_way": TWO_WAY,
    "calibration_sample": f"select doc_id, source, case when {h32(chr(39) + 'half|' + chr(39) + ' || doc_id')} % 2 = 0 then 'fit' else 'eval' end as half from documents qualify row_number() over (partition by source order by substr(sha1('calib|' || doc_id), 1, 16)) <= 12",
    "best_variant": "with v(variant, t) as (values ('plain', 1.0::DOUBLE), ('soft', 3.0), ('sharp', 0.5)), x as (select vec_id, label, k, embedding[k + 1]::DOUBLE * 10.0::DOUBLE as x from embeddings cross join range(10) r(k) where label between 0 and 9), e as (select vec_id, variant, -ln(greatest(max(case when k = label then exp(x / t) end) / sum(exp(x / t)), 1e-12::DOUBLE)) as l from x cross join v group by 1, 2), s as (select variant, round(sum(l), 4) as loss from e group by 1) select arg_min(variant, loss) as variant, min(loss) as loss from s",
}
