"""Queries of acceptance checks, profiles, requests and written rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import build
from .common import split_of, table


def check_row(frame: DataFrame, name: str, value: Column, low: float | None, high: float | None) -> DataFrame:
    """One acceptance check as a row (name, value, status): MISSING without a value, else PASS or FAIL by its bounds."""
    v = F.round(value.cast("double"), 6)
    ok = F.lit(True)
    ok = ok if low is None else ok & (F.col("value") >= low)
    ok = ok if high is None else ok & (F.col("value") <= high)
    return frame.agg(v.alias("value")).select(F.lit(name).alias("name"), "value", F.when(F.col("value").isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL").alias("status"))


def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the documents as a dataset of questions: sources as images, languages as types."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    distinct = docs.groupBy("source").agg(F.countDistinct(text.dedup_key(F.col("text"))).alias("q"), F.countDistinct("lang").alias("types"))
    langs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    opening = docs.groupBy(F.lower(text.opening(F.col("text"))).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    bools = build.vote_spread_bool(spark, sf_dir)
    share = lambda c: F.avg(c.cast("double"))
    spec = F.create_map(*(F.lit(x) for kv in (("en", 0.6), ("de", 0.15), ("fr", 0.15), ("es", 0.1)) for x in kv))
    total = langs.crossJoin(F.broadcast(langs.agg(F.sum("n").alias("total"))))
    return reduce(
        DataFrame.unionByName,
        [
            check_row(docs, "invalid rows", F.count_if(text.stripped(F.col("text")) == ""), None, 0),
            check_row(distinct, "distinct per source", F.avg("q"), 4.5, None),
            check_row(distinct, "sources with three or more", share(F.col("q") >= 3), 0.9, None),
            check_row(distinct, "sources with two types", share(F.col("types") >= 2), 0.75, None),
            check_row(docs, "share of english", share(F.col("lang") == "en"), 0.5, 0.7),
            check_row(docs, "share of german", share(F.col("lang") == "de"), 0.2, 0.3),
            check_row(docs, "not applicable", share(F.col("quality") == 0), 0.08, 0.12),
            check_row(bools, "mean yes", F.avg("p_yes"), 0.45, 0.55),
            check_row(docs, "either/or without a verdict", F.count_if(text.is_either_or(F.col("text")) & F.col("quality").isNull()), None, 0),
            check_row(total, "deviation from the mix", F.max(F.abs(F.col("n") / F.col("total") - spec[F.col("lang")])), None, 0.03),
            check_row(opening, "largest opening", F.max("n") / F.sum("n"), None, 0.01),
            check_row(langs, "languages of five per cent", F.count_if(F.col("n") >= 50), 4, None),
            check_row(docs.where("lang = 'xx'"), "mean length of a language without documents", F.avg("n_chars"), 1, None),
            check_row(docs, "toxic in training", F.count_if((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0)), None, 0),
        ],
    )


_D = "(select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))"
_S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_CHECKS = [
    ("invalid rows", f"select count(*) filter ({_S} = '') as value from {_D}", None, 0),
    ("distinct per source", f"select avg(q) as value from (select count(distinct lower({_S})) as q from documents group by source)", 4.5, None),
    ("sources with three or more", f"select avg((q >= 3)::INT) as value from (select count(distinct lower({_S})) as q from documents group by source)", 0.9, None),
    ("sources with two types", "select avg((q >= 2)::INT) as value from (select count(distinct lang) as q from documents group by source)", 0.75, None),
    ("share of english", "select avg((lang = 'en')::INT) as value from documents", 0.5, 0.7),
    ("share of german", "select avg((lang = 'de')::INT) as value from documents", 0.2, 0.3),
    ("not applicable", "select avg((quality = 0)::INT) as value from labels join documents using (doc_id)", 0.08, 0.12),
    ("mean yes", f"select avg(p_yes) as value from ({build.VOTES})", 0.45, 0.55),
    ("either/or without a verdict", f"select count(*) filter (regexp_matches(text, '[0-9A-Za-z_] or [0-9A-Za-z_]') and quality is null) as value from {_D}", None, 0),
    ("deviation from the mix", "select max(abs(n / s::DOUBLE - case lang when 'en' then 0.6 when 'de' then 0.15 when 'fr' then 0.15 when 'es' then 0.1 end)) as value from (select lang, count(*) as n, sum(count(*)) over () as s from documents group by 1)", None, 0.03),
    ("largest opening", rf"select max(n) / sum(n)::DOUBLE as value from (select count(*) as n from documents group by lower(array_to_string(regexp_split_to_array({_S}, '\s+')[1:4], ' ')))", None, 0.01),
    ("languages of five per cent", "select count(*) filter (n >= 50) as value from (select count(*) as n from documents group by lang)", 4, None),
    ("mean length of a language without documents", "select avg(n_chars) as value from documents where lang = 'xx'", 1, None),
    ("toxic in training", f"select count(*) filter (toxic = 1 and doc_id % 2 = 0) as value from {_D}", None, 0),
]
CHECKS = " union all ".join(
    f"select '{n}' as name, round(value::DOUBLE, 6) as value, case when value is null then 'MISSING' when " + (" and ".join([*([f"round(value::DOUBLE, 6) >= {lo}"] if lo is not None else []), *([f"round(value::DOUBLE, 6) <= {hi}"] if hi is not None else [])])) + f" then 'PASS' else 'FAIL' end as status from ({q})" for n, q, lo, hi in _CHECKS
)


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: rows, distinct texts, share of the five most frequent (source_top_share: of fifty), languages, share of labelled."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("source", "lang", "quality", text.dedup_key(F.col("text")).alias("key"))
    counts = docs.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rk", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.md5("key"))))
    strings = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("distinct_texts"), F.round(F.sum(F.when(F.col("rk") <= 5, F.col("n"))) / F.sum("n"), 6).alias("top_share"))
    rest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.avg(F.col("quality").isNotNull().cast("double")), 6).alias("labelled"))
    return rest.join(strings, "source")


PROFILE = rf"""
with d as (select d.*, l.quality, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) as key from documents d left join labels l using (doc_id)),
c as (select source, key, count(*) as n from d group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, md5(key)) as rk from c),
s as (select source, count(*) as distinct_texts, round(sum(n) filter (rk <= 5) / sum(n)::DOUBLE, 6) as top_share from r group by 1)
select source, count(*) as n, count(distinct lang) as langs, round(avg((quality is not null)::INT), 6) as labelled, any_value(distinct_texts) as distinct_texts, any_value(top_share) as top_share from d join s using (source) group by 1"""


def language_share_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of languages with five per cent of the documents or more, by share and not by rows as in acceptance_checks."""
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = langs.where("lang is not null").crossJoin(F.broadcast(langs.agg(F.sum("n").alias("total"))))
    return check_row(total, "languages of five per cent", F.count_if(F.col("n") * 20 >= F.col("total")), 4, None)


def source_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share of its fifty most frequent texts (A8-A12); source_profile has that of the first five."""
    counts = table(spark, sf_dir, "documents").groupBy("source", text.dedup_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rk", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"))))  # equal counts add up the same in any order
    return ranked.groupBy("source").agg(F.round(F.sum(F.when(F.col("rk") <= 50, F.col("n"))) / F.sum("n"), 6).alias("top_share"))


def share_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level shares by source, the largest deviation of a source's mix from the whole."""
    docs = table(spark, sf_dir, "documents")
    all_langs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("m")).withColumn("want", F.col("m") / F.sum("m").over(Window.partitionBy()))
    own = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    joined = own.join(F.broadcast(all_langs.select("lang", "want")), "lang")
    return joined.groupBy("source").agg(F.round(F.max(F.abs(F.col("share") - F.col("want"))), 6).alias("deviation"), F.round(F.max("share"), 6).alias("largest"))


SHARES = """
with a as (select lang, count(*) / sum(count(*)) over ()::DOUBLE as want from documents group by 1),
o as (select source, lang, count(*) / sum(count(*)) over (partition by source)::DOUBLE as share from documents group by 1, 2)
select source, round(max(abs(share - want)), 6) as deviation, round(max(share), 6) as largest from o join a using (lang) group by 1"""


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing reason of requests built from events."""
    k, i = F.from_json("props", "k int")["k"], F.col("event_id")
    n, chars, options, lo, hi = k % 23, k * 4, F.when(i % 5 == 0, F.array(F.lit("A"), F.lit("a"))).otherwise(F.array(F.lit("A"), F.lit("B"))), i % 4, i % 13
    reason = F.when((n < 1) | (n > 20), "1 to 20 questions").when(chars > 300, "text too long").when((i % 3 == 0) & (F.size(F.array_distinct(F.transform(options, F.lower))) < 2), "options not distinct").when((i % 3 == 1) & ((lo >= hi) | (hi > 10)), "bad scale")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


def writer_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse written JSON, normalise it and give the first reason to reject it."""
    i = F.col("p_partkey")
    raw = F.when(i % 29 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("  what   is "), F.col("p_name"), F.when(i % 7 == 0, " or not").otherwise(""), F.lit("? ")).alias("q"), F.when(i % 5 == 0, F.array(F.lit("not_sure"), F.lit("ok"))).when(i % 11 == 0, F.array(F.lit("N/A"), F.lit("ok"))).when(i % 13 == 0, F.array(F.lit("ok"))).otherwise(F.array(F.lit("ok"), F.lit("bad"))).alias("options"))))
    rows = table(spark, sf_dir, "part").select(i, raw.alias("raw")).withColumn("j", F.from_json("raw", "q string, options array<string>"))
    q = text.capitalised(text.collapsed(F.col("j.q")))
    reason = (
        F.when(F.col("j.q").isNull(), "not json").when(~F.length(q).between(12, 200), "length").when(text.is_either_or(q), "either/or").when(F.size("j.options") < 2, "too few options")
        .when(F.exists("j.options", lambda o: F.contains(o, F.lit("_"))), "snake case").when(F.exists("j.options", text.is_na_like), "n/a-like option")
    )
    return rows.select("p_partkey", F.when(reason.isNull(), q).alias("q"), reason.alias("reason"))


WRITER = """
with r as (select p_partkey as i, p_partkey % 29 = 0 as broken, 'What is ' || p_name || case when p_partkey % 7 = 0 then ' or not' else '' end || '?' as q from part)
select i as p_partkey, case when not broken and length(q) between 12 and 200 and i % 7 <> 0 and i % 13 * (i % 5 = 0 or i % 11 = 0)::INT + (i % 13 > 0)::INT > 0 and i % 5 <> 0 and i % 11 <> 0 and i % 13 <> 0 then q end as q,
  case when broken then 'not json' when length(q) not between 12 and 200 then 'length' when i % 7 = 0 then 'either/or' when i % 5 = 0 then 'snake case' when i % 11 = 0 then 'n/a-like option' when i % 13 = 0 then 'too few options' end as reason from r"""


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text and its Base64 (F22), of benchmark items."""
    raw = F.concat(F.lit("<b>"), F.col("text"), F.lit("</b> & 'x'"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(text.escape_html(raw)).alias("escaped"), F.length(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")).alias("n64"))


QUERIES = {f.__name__: f for f in (acceptance_checks, source_profile, language_share_check, source_top_share, share_checks, request_validation, writer_postprocess, html_escape)}
SQL = {
    "acceptance_checks": CHECKS,
    "source_profile": PROFILE,
    "share_checks": SHARES,
    "request_validation": "with e as (select event_id as i, (props->>'$.k')::INT as k from events) select i as event_id, case when k % 23 < 1 or k % 23 > 20 then '1 to 20 questions' when k * 4 > 300 then 'text too long' when i % 3 = 0 and i % 5 = 0 then 'options not distinct' when i % 3 = 1 and (i % 4 >= i % 13 or i % 13 > 10) then 'bad scale' end as reason from e",
    "writer_postprocess": WRITER,
    "html_escape": "select item_id, md5(replace(replace(replace(replace(replace('<b>' || text || '</b> & ''x''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as escaped, length(base64(encode(text)))::INT as n64 from benchmark",
}
