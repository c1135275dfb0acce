"""Queries of sequential folds and event windows. Their SQL is a recursive or windowed restatement where that is short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stateful
from .common import table

def _seconds():
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")



def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five accepted requests a day for each user."""
    events = table(spark, sf_dir, "events").select("user_id", _seconds(), "event_id")
    return stateful.rate_limit(events, "user_id", "t", "event_id", 5, 86_400.0).select("event_id", "accepted")


#: The admission as a recursion over each user's requests, with the accepted times as a list.
LIMIT = """
with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, event_id, rn, [t] as held, true as accepted from e where rn = 1
  union all
  select e.user_id, e.event_id, e.rn,
    case when len(list_filter(f.held, lambda h: e.t - h <= 86400)) < 5 then list_append(list_filter(f.held, lambda h: e.t - h <= 86400), e.t) else list_filter(f.held, lambda h: e.t - h <= 86400) end,
    len(list_filter(f.held, lambda h: e.t - h <= 86400)) < 5
  from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select event_id, accepted from f"""


def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("grp"), F.col("n_chars"), "doc_id")
    return stateful.token_batches(docs, "grp", "n_chars", "doc_id", 7000).select("doc_id", "batch")


BATCHES = """
with recursive d as (select doc_id // 8 as grp, n_chars as s, doc_id, row_number() over (partition by doc_id // 8 order by n_chars, doc_id) as rn from documents),
f as (select grp, doc_id, rn, 0 as batch, 1 as n, s as longest from d where rn = 1
  union all
  select d.grp, d.doc_id, d.rn, case when greatest(f.longest, d.s) * (f.n + 1) > 7000 then f.batch + 1 else f.batch end,
    case when greatest(f.longest, d.s) * (f.n + 1) > 7000 then 1 else f.n + 1 end, case when greatest(f.longest, d.s) * (f.n + 1) > 7000 then d.s else greatest(f.longest, d.s) end
  from f join d on d.grp = f.grp and d.rn = f.rn + 1)
select doc_id, batch from f"""

WEIGHTS = {"bool_yes": 0.25, "bool_no": 0.25, "choice": 0.35, "score": 0.15}


def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind for each supplier, by quotas, never the one that its nation excludes."""
    kinds = F.array(*(F.lit(k) for k in WEIGHTS))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(kinds, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("excluded"))
    return stateful.quota_plan(rows, "s_suppkey", WEIGHTS, "excluded")


_SCORE = "list_max(list_transform(list_filter(f.c, lambda x: x.k <> e.excluded), lambda x: round(x.w * (f.total + 1) - x.n, 9)))"
QUOTA = f"""
with recursive e as (select s_suppkey, ['bool_yes', 'bool_no', 'choice', 'score'][s_nationkey % 4 + 1] as excluded, row_number() over (order by s_suppkey) as rn from supplier),
f as (select 0::BIGINT as rn, 0::BIGINT as total, null::BIGINT as s_suppkey, null::VARCHAR as value, [{{'k': 'bool_yes', 'w': 0.25::DOUBLE, 'n': 0}}, {{'k': 'bool_no', 'w': 0.25::DOUBLE, 'n': 0}}, {{'k': 'choice', 'w': 0.35::DOUBLE, 'n': 0}}, {{'k': 'score', 'w': 0.15::DOUBLE, 'n': 0}}] as c
  union all
  select g.rn, g.total, g.s_suppkey, g.value, list_transform(g.c, lambda x: {{'k': x.k, 'w': x.w, 'n': x.n + (x.k = g.value)::INT}}) from (
    select e.rn, f.total + 1 as total, e.s_suppkey, f.c, list_sort(list_transform(list_filter(f.c, lambda x: x.k <> e.excluded and round(x.w * (f.total + 1) - x.n, 9) = {_SCORE}), lambda x: {{'h': substr(sha1(e.s_suppkey || '|' || x.k), 1, 16), 'k': x.k}}))[1].k as value
    from f join e on e.rn = f.rn + 1) g)
select s_suppkey, value from f where rn > 0"""


def lru_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each access of a user finds its key among the last sixteen distinct ones."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json("props", "k int")["k"].alias("k"))
    return stateful.lru(events, "user_id", "event_id", "k", 16).select("event_id", "hit")


LRU = """
with e as (select user_id, event_id, (props->>'$.k')::INT as k from events),
p as (select *, lag(event_id) over (partition by user_id, k order by event_id) as prev from e)
select p.event_id, p.prev is not null and (select count(distinct q.k) from e q where q.user_id = p.user_id and q.event_id > p.prev and q.event_id < p.event_id) < 16 as hit from p"""


def near_duplicate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in order, without near duplicates of accepted ones; a count and the last id remain."""
    kept = stateful.without_near_duplicates(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value in windows of six hours by type."""
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    counted = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "value")


QUERIES = {f.__name__: f for f in (rate_limit, token_batches, quota_plan, lru_recency, near_duplicate_fold, event_windows)}
SQL = {
    "rate_limit": LIMIT,
    "token_batches": BATCHES,
    "quota_plan": QUOTA,
    "lru_recency": LRU,
    "event_windows": "select epoch(time_bucket(interval 6 hours, ts))::BIGINT as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
}
