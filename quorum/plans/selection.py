"""The selection of a training set as one query: events are questions about the users who made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, hashing
from ..operators import selection
from .common import h32, split_of, table, uniform

CAPS = {"signup": 900, "error": 500, "view": 1500}
TOPICS, OPENINGS, OPENING_CAP = 10, 9, 0.1


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is a choice of three to five options, the others are yes/no; views and clicks are a teacher's."""
    key, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k").cast("int")
    choice = F.col("event_id") % 3 == 0
    r = hashing.h32(F.lit("p"), key) % 10001
    numbers = F.sequence(F.lit(0), 2 + (F.col("event_id") % 4 % 3).cast("int"))
    weights = F.transform(numbers, lambda j: (hashing.h32(F.lit("w"), key, j.cast("string")) % 9 + 1).cast("double"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("image"), hashing.split_of(F.concat(F.lit("u_"), F.col("user_id").cast("string"))).alias("split"), F.col("event_type").alias("source"),
        F.col("event_type").isin("view", "click").alias("teacher"), F.when(choice, "choice").otherwise("bool").alias("type"), F.floor(k / 10).cast("string").alias("topic"), (k % OPENINGS).cast("string").alias("opening"),
        F.when(~choice, 10000 - F.floor(r * r / 10000)).alias("p_yes"), F.when(choice, F.transform(numbers, lambda j: F.concat(F.lit("o"), j.cast("string")))).alias("options"), F.when(choice, dist.normalised(weights)).alias("target"),
    )


def selected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions of the selected set with their images' names."""
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), F.col("c_name").alias("name"))
    done = selection.select(_questions(spark, sf_dir), manifest, CAPS, opening_cap=OPENING_CAP)
    return done["questions"].join(done["images"], "image", "left").select("id", "image", "name", "split", "source", "aug", F.array_join("options", ",").alias("options"), dist.shown(F.col("target"), 6).alias("target"))


def _cap_steps(name: str, column: str, values: int, share: float, first: str, density: str) -> str:
    """Unrolled: each value's surplus goes from the densest images, whose densities the next value sees."""
    out, before = f",\n{name}_n as (select floor({share} * (select count(*) from kept where teacher))::BIGINT as cap)", density
    for v in range(values):
        out += f""",
{name}_d{v} as materialized (select id, image from (select t.id, t.image, row_number() over (order by d.density desc, substr(sha1('{name}|{v}|' || t.id), 1, 16), t.id) as rn, count(*) over () as many from {first} t join {before} d using (image) where t.{column} = '{v}') where rn <= many - (select cap from {name}_n)),
{name}_s{v} as materialized (select d.image, d.density - coalesce(x.less, 0) as density from {before} d left join (select image, count(*) as less from {name}_d{v} group by 1) x using (image))"""
        before = f"{name}_s{v}"
    gone = " union all ".join(f"select id from {name}_d{v}" for v in range(values))
    return out + f",\n{name}_kept as materialized (select * from {first} where id not in ({gone}))"


SELECTED = (
    f"""
with e as (select event_id as id, user_id as image, {split_of("'u_' || user_id")} as split, event_type as source, event_type in ('view', 'click') as teacher, event_id % 3 = 0 as choice, (props->>'k')::INT as k, {h32("'p|' || event_id")} % 10001 as r from events),
qs as materialized (select *, (k // 10)::VARCHAR as topic, (k % {OPENINGS})::VARCHAR as opening, case when not choice then 10000 - r * r // 10000 end as p_yes from e),
kept as materialized (select * from (select *, row_number() over (partition by source order by substr(sha1('cap|' || source || '|' || id), 1, 16), id) as rn from qs where split = 'train') where rn <= case source {" ".join(f"when '{k}' then {v}" for k, v in CAPS.items())} else 1e18 end),
teacher_ as materialized (select * from kept where teacher),
density as materialized (select image, count(*) as density from kept group by 1)"""
    + _cap_steps("topic", "topic", TOPICS, 0.08, "teacher_", "density") + _cap_steps("opening", "opening", OPENINGS, OPENING_CAP, "topic_kept", f"topic_s{TOPICS - 1}")
    + f""",
asked as (select sum(p_yes) as total, count(*) as many from opening_kept where p_yes is not null),
heavy as (select id, row_number() over w as rn, (total - sum(p_yes) over w) / (many - row_number() over w) as mean_after from opening_kept join opening_s{OPENINGS - 1} using (image) cross join asked where p_yes > 5000 and total > 0.55 * 10000 * many window w as (order by density desc, substr(sha1('yes|' || id), 1, 16), id)),
gone as (select id from heavy where rn <= coalesce((select min(rn) from heavy where mean_after <= 5000), rn)),
train as materialized (select * exclude (rn) from opening_kept where id not in (select id from gone) union all select * exclude (rn) from kept where not teacher),
w as (select id, j, ({h32("'w|' || id || '|' || j")} % 9 + 1)::DOUBLE as w from qs cross join range(5) t(j) where choice and j < 3 + id % 4 % 3),
o as materialized (select id, j, 'o' || j as o, w / sum(w) over (partition by id) as t, row_number() over (partition by id order by w desc, j) as rk, count(*) over (partition by id) as m from w),
own as (select id, string_agg(o, ',' order by j) as options, string_agg(printf('%.6f', t), ',' order by j) as target from o group by 1),
lost as (select o.*, row_number() over (partition by id, rk = 1 order by substr(sha1('lose|' || id || '|' || o), 1, 16)) as lk from o),
few as (select lost.id, o, t / sum(t) over (partition by lost.id) as t, substr(sha1('mix|' || lost.id || '|' || o), 1, 16) as h from lost join train on train.id = lost.id
  where not teacher and {uniform("'aug|' || lost.id")} < 0.5 and (rk = 1 or lk <= case when m > 3 then 1 + {h32("'k|' || lost.id")} % 2 else 1 end)),
var as (select id, string_agg(o, ',' order by h) as options, string_agg(printf('%.6f', t), ',' order by h) as target from few group by 1),
done as (select id, image, split, source, false as aug, options, target from (select * from train union all select * from qs where split <> 'train') left join own using (id)
  union all select id, image, split, source, true, options, target from var join train using (id))
select id, image, c_name as name, split, source, aug, options, target from done left join customer on c_custkey = image"""
)

QUERIES = {"selected_questions": selected_questions}
SQL = {"selected_questions": SELECTED}
