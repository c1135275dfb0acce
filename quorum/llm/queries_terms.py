"""Registered queries of the operators on terms and phrases (11, 12) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, divergence


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the sources of each language, and the terms that stand out in each."""
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words belong together most."""
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_phrase_collocations": op12_phrase_collocations}

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11 = rf"""
with d as (select row_number() over () as r, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
x as (select r, lang, source, term, count(*) as n from w group by all),
k as (select lang, term, sum(n)::hugeint as n from x group by all having count(*) >= 30),
c as (select lang, source, term, sum(x.n)::hugeint as n from x semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(n)::hugeint as total from k group by all),
gt as (select lang, source, sum(n)::hugeint as total from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000 * (coalesce(c.n, 0) + 5)::hugeint) // (coalesce(gt.total, 0) + 5 * v.v))::bigint as p,
  (1 + (1000000000 * (k.n + 5)::hugeint) // (v.total + 5 * v.v))::bigint as q
  from g join k using (lang) join v using (lang) left join gt using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(far.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank::integer as rank from ranked where part = 'pair' or rank <= 50
"""
OP12 = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), {LOWER}) as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) x(m) where len(ws) >= m),
f as (select lang, m, phrase, string_split(phrase, ' ') as ws, count(*)::hugeint as f from g group by all having count(*) >= 30),
cut as (select lang, phrase, f as a, k, array_to_string(ws[1:k], ' ') as first_, array_to_string(ws[k + 1:], ' ') as rest from f, (values (1), (2), (3)) x(k) where k < m),
c as (select cut.lang, cut.phrase, a, k, l.f as l, r.f as r, (2000000 * a) // (l.f + r.f) as score from cut join f l on l.lang = cut.lang and l.phrase = first_ join f r on r.lang = cut.lang and r.phrase = rest),
lowest as (select * from c qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, array_to_string(ws[i:i + s - 1], ' ') as phrase, max(f) as longer from f, (values (2), (3)) y(s), (values (1), (2), (3)) x(i) where s < m and i + s - 1 <= m group by all),
own as (select lowest.* from lowest left join inner_ using (lang, phrase) where longer is null or 100 * longer < 80 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from own)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""
SQL = {"op11_source_divergence": OP11, "op12_phrase_collocations": OP12}
