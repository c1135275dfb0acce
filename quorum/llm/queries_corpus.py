"""Registered queries of the corpus operators (1-3, 5-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, nearest, ngram_join, quality, secrets, toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, per_cent=90).drop("first")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by corpus-wide ownership."""
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < secrets.BASE)
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), live.alias("n_live"))


CONFLICT = "\\### Assistant: </turn> ok"


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all rows."""
    return nearest.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that states markers of the template; read the result back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = F.lit(CONFLICT)
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    done = chat.format_chats(rows.unionByName(extra))
    turns, loss = chat.parse(F.col("formatted")), chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    read = done.withColumn("turns", turns).withColumn("loss", loss)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the base rule and the trees for every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.assess(docs, quality.train(docs, labels))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; rows that are held out are never learnt from."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels, where=~held_out(F.col("doc_id")))
    return toxicity.assess(docs, machine).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op3_nearest_neighbours": op3_nearest_neighbours, "op5_html_extraction": op5_html_extraction, "op7_quality_rules": op7_quality_rules, "op8_toxicity": op8_toxicity, "op2_secret_scans": op2_secret_scans, "op6_chat_formatting": op6_chat_formatting}

OP6 = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked as (
  select *, regexp_matches(text, '\\[elh]') or regexp_matches(role, '\\[elhw]') or contains(role || chr(10) || text, '</turn>') or contains(role, chr(10)) as bad,
    length(text) + length(role) + 13 as plain,
    length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) as more
  from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(plain + case when bad then more else 0 end) + count(*) - 1 as bigint) as formatted_chars
from marked group by conv_id
"""
OP1 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as shingles from w),
n as (select doc_id, len(shingles) as n from s), e as (select doc_id, hash(unnest(shingles)) as h from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as inter from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * inter >= 90 * (a.n + b.n - inter)),
d as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as root from documents union select d.y, r.root from r join d on d.x = r.x)
select n.doc_id, n.n as n_shingles, c.root as component_id, coalesce(k.links, 0) as n_links
from n join (select x, min(root) as root from r group by 1) c on c.x = n.doc_id left join (select x, count(*) as links from d group by 1) k on k.x = n.doc_id
"""
#: Kinds for an engine without look-around: pattern, groups before the span and of the value, and what a value must be. A vendor's key takes
#: the character before it into its match; an entropy span is a whole run that holds a digit and letters of both cases.
_SHAPES = (
    ("assign", secrets.KINDS[0][1], None, 2, "length(v) >= 6"),
    ("access", secrets.KINDS[1][1], None, 0, "true"),
    ("hex", secrets.KINDS[2][1], None, 0, "true"),
    ("jwt", secrets.KINDS[3][1], None, 0, "true"),
    ("vendor", "(^|[^A-Za-z0-9])(" + secrets.KINDS[4][1].split(")", 1)[1] + ")", 1, 2, "true"),
    ("pem", secrets.KINDS[5][1], None, 0, "true"),
    ("entropy", "[A-Za-z0-9+/_-]+", None, 0, "length(v) >= 32 and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]')"),
)


def _shape(rank: int) -> str:
    kind, pattern, before, value, test = _SHAPES[rank]
    quoted = "'" + pattern.replace("'", "''") + "'"
    taken = f"regexp_extract_all(text, {quoted}, {before})" if before else "[]::VARCHAR[]"
    return f"""select row_key, rank, kind, finish - length(m) + coalesce(length(b), 0) as start, finish as "end", sha256(v) as hash from (
  select *, sum(length(g) + length(m)) over (partition by row_key order by nth) as finish from (
    select row_key, {rank} as rank, '{kind}' as kind, unnest(matches) as m, unnest(list_resize(befores, len(matches))) as b, unnest(vals) as v, unnest(gaps[1:len(matches)]) as g, unnest(range(1, len(matches) + 1)) as nth from (
      select row_key, regexp_extract_all(text, {quoted}, 0) as matches, regexp_extract_all(text, {quoted}, {value}) as vals, {taken} as befores, string_split_regex(text, {quoted}) as gaps from d where regexp_matches(text, {quoted})))) where {test}"""


OP2 = f"""
with d as (select row_number() over () as row_key, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(lang, '') as lang from documents),
s as ({" union all ".join(_shape(k) for k in range(len(_SHAPES)))}),
o as (select hash, count(distinct owner) < 3 and count(distinct (owner, lang)) < 6 as live from s join d using (row_key) group by 1),
k as (select s.*, live, kind || ':' || start || ':' || "end" as said from s join o using (hash) where rank < {secrets.BASE} or live),
t as (select row_key, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, count(*) filter (live) as n_live,
  string_agg(said, ',' order by start, rank) filter (rank < {secrets.BASE}) as base, string_agg(said, ',' order by start, rank) as spans from k group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_live, 0) as n_live, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join t using (row_key)
"""
SQL = {"op1_ngram_join": OP1, "op2_secret_scans": OP2, "op6_chat_formatting": OP6}
