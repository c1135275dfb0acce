"""Queries of the builders: votes, choices, histograms, ids, rules, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist, hashing, rules, text
from ..operators import builders
from ..operators.ordinal import numbered
from .common import h32, split_of, table, uniform

ORDER = ["l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
COLOURS = r"\b(red|blue|green|yellow|white|black|brown|orange|pink|purple|grey|gray|silver|gold)\b"
CONDITION = r"\b(hot|cold|small|large|big|new|old|fast|slow)\b"


def vote_spread_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = builders.vote_spread_bool(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "R", "A")
    return votes.select(F.col("l_partkey").alias("part_id"), "n_yes", "n_no", "p_yes", "p_no")


VOTES = """
select l_partkey as part_id, count(*) filter (l_returnflag = 'R') as n_yes, count(*) filter (l_returnflag = 'A') as n_no,
  round(count(*) filter (l_returnflag = 'R') / (count(*) filter (l_returnflag in ('R', 'A')))::DOUBLE, 4) as p_yes,
  round(1 - round(count(*) filter (l_returnflag = 'R') / (count(*) filter (l_returnflag in ('R', 'A')))::DOUBLE, 4), 4) as p_no
from lineitem group by 1 having count(*) filter (l_returnflag in ('R', 'A')) >= 8"""


def split_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.split_of(key).alias("split"), hashing.h32(key).alias("h"))


def vote_spread_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modal answer, two distractors from the pool of the kind that no vote names, and the options' order."""
    votes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    ranked = builders.modal_answers(votes, "l_partkey", "l_linenumber", ORDER)
    modal = ranked.where("rk = 1 and n >= 4").select(F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("answer"), F.col("n").alias("mode_n"))
    pool = builders.answer_pools(votes, "p_type", "l_linenumber", 6, 500, 0.6).select("p_type", F.col("l_linenumber").alias("other"), F.col("n").alias("w"))
    top = ranked.where("rk <= 3").select(F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("other"))
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_type")
    candidates = modal.join(kinds, "part_id").join(F.broadcast(pool), "p_type").join(top, ["part_id", "other"], "left_anti")
    key = (F.col("part_id").cast("string"), F.col("other").cast("string"))
    drawn = builders.weighted_pick(candidates, "part_id", F.col("w").cast("double"), 2, *key).groupBy("part_id").agg(F.collect_list("other").alias("others"), F.count(F.lit(1)).alias("k"))
    options = F.concat(F.array("answer"), "others")
    shuffled = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(hashing.order_key(F.lit("order"), F.col("part_id").cast("string"), o.cast("string")).alias("h"), o.alias("o")))), lambda x: x["o"])
    both = modal.join(drawn.where("k = 2"), "part_id")
    return both.select("part_id", "answer", "mode_n", F.array_join(shuffled.cast("array<string>"), ",").alias("options"))


CHOICE = f"""
with v as (select l.*, p.p_type, row_number() over (partition by l_partkey order by {", ".join(ORDER)}) as pos from lineitem l join part p on l_partkey = p_partkey),
c as (select l_partkey, l_linenumber, count(*) as n, min(pos) as first_pos from v group by 1, 2),
r as (select *, row_number() over (partition by l_partkey order by n desc, first_pos) as rk from c),
m as (select l_partkey as part_id, l_linenumber as answer, n as mode_n from r where rk = 1 and n >= 4),
pc as (select p_type, l_linenumber, count(*) as n from v group by 1, 2),
pr as (select *, row_number() over (partition by p_type order by n desc, l_linenumber) as rk, sum(n) over (partition by p_type) as total from pc),
ph as (select *, sum(case when rk <= 6 then n end) over (partition by p_type) as held from pr),
pool as (select p_type, l_linenumber as other, n as w from ph where rk <= 6 and total >= 500 and held >= 0.6 * total),
cand as (select m.part_id, m.answer, pool.other, pool.w from m join part p on m.part_id = p.p_partkey join pool on pool.p_type = p.p_type
  where not exists (select 1 from r where r.l_partkey = m.part_id and r.rk <= 3 and r.l_linenumber = pool.other)),
d as (select *, row_number() over (partition by part_id order by -ln({uniform("part_id || '|' || other")}) / w) as pick from cand),
k as (select part_id, list(other) as others from d where pick <= 2 group by 1 having count(*) = 2)
select m.part_id, m.answer, m.mode_n,
  array_to_string(list_transform(list_sort(list_transform(list_prepend(m.answer, k.others), lambda o: {{'h': substr(sha1('order|' || m.part_id || '|' || o), 1, 16), 'o': o}})), lambda x: x.o), ',') as options
from m join k using (part_id)"""


def vote_histogram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.least(F.lit(5), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int"))
    votes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(bucket == k).alias(f"c{k}") for k in range(1, 6)))
    p = builders.histogram_target([F.col(f"c{k}") for k in range(1, 6)])
    return votes.withColumn("p", p).select(F.col("l_suppkey").alias("supp_id"), *(F.element_at("p", k).alias(f"p{k}") for k in range(1, 6)))


_B = "least(5, 1 + floor((l_quantity - 1) / 10))"
HISTOGRAM = "select l_suppkey as supp_id, " + ", ".join(f"round(count(*) filter ({_B} = {k}) / count(*)::DOUBLE, 4) as p{k}" for k in range(1, 6)) + " from lineitem group by 1"


def one_hot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").between(0, 9))
    return rows.select("vec_id", F.array_join(dist.one_hot(10, F.col("label")).cast("array<int>").cast("array<string>"), "").alias("target"))


def family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = text.first_family(F.col("p_name"), [("color", COLOURS), ("condition", CONDITION)])
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), rules.family(F.concat(F.lit("is there a "), F.col("p_name"), F.lit("?"))).alias("question_family"))


_Q = "lower('is there a ' || p_name || '?')"
FAMILY = (
    rf"select p_partkey, case when regexp_matches(lower(p_name), '{COLOURS}') then 'color' when regexp_matches(lower(p_name), '{CONDITION}') then 'condition' else 'other' end as family, case "
    + " ".join(f"when regexp_matches({_Q}, '{p}') then '{n}'" for n, p in rules.FAMILIES)
    + " else 'other' end as question_family from part"
)


def supplier_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of all events as suppliers of nations: those of nation 0 have no target, users beyond the suppliers are unknown."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_nationkey")
    return builders.crosswalk(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", known, "s_nationkey", "coco_%012d", "vg_%d").select("event_id", "mapped")


def hash_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrasings = F.array(*(F.lit(x) for x in ("How good is it?", "Rate it.", "What is its quality?")))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.pick(phrasings, F.col("doc_id").cast("string")).alias("q"))


def unanswerable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    marks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("?"), F.lit("")))
    rows = table(spark, sf_dir, "conversations").where(low.rlike("^(is|are|the|in|of|on) ") & ~low.rlike("(^| )(what|which|how|why)( |$)") & (marks <= 1))
    return rows.select("conv_id", "turn", marks.cast("long").alias("marks"))


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract(url, "/([a-z]{2})/", 1).alias("folder"), F.regexp_extract(url, r"/(\d+)(?:[?#].*)?$", 1).alias("number"))


def unique_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines whose part name is unique in the order, as (subject, object) in key order, half of them swapped."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    unique = builders.unique_within(lines, "l_orderkey", F.col("p_name"))
    pairs = unique.withColumnRenamed("name", "a").join(unique.withColumnRenamed("name", "b"), "l_orderkey").where("a < b")
    swap = hashing.h32(F.col("l_orderkey").cast("string"), F.col("a"), F.col("b")) % 2 == 1
    return pairs.select("l_orderkey", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("subject"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("object"), swap.alias("swapped"))


PAIRS = f"""
with u as (select l_orderkey, p_name as name from lineitem join part on l_partkey = p_partkey group by 1, 2 having count(*) = 1),
p as (select x.l_orderkey, x.name as a, y.name as b, {h32("x.l_orderkey || '|' || x.name || '|' || y.name")} % 2 = 1 as swapped from u x join u y on x.l_orderkey = y.l_orderkey and x.name < y.name)
select l_orderkey, case when swapped then b else a end as subject, case when swapped then a else b end as object, swapped from p"""


def attribute_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with exactly one colour word: the colour, three other colours by hash, and no leak of the answer."""
    vocabulary = F.array(*(F.lit(c) for c in ("red", "blue", "green", "yellow", "white", "black", "gray")))
    name = F.replace(F.lower("p_name"), F.lit("grey"), F.lit("gray"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", name.alias("name")).withColumn("words", text.words_of(F.col("name"))).withColumn("hits", F.array_intersect("words", vocabulary)).where(F.size("hits") == 1)
    answer = F.element_at("hits", 1)
    noun = F.element_at(F.array_except("words", "hits"), -1)
    others = F.transform(F.slice(F.array_sort(F.transform(F.array_except(vocabulary, "hits"), lambda c: F.struct(hashing.order_key(F.col("p_partkey").cast("string"), c).alias("h"), c.alias("c")))), 1, 3), lambda x: x["c"])
    question = F.concat(F.lit("What colour "), text.agreement(noun), F.lit(" the "), noun, F.lit("?"))
    made = rows.select("p_partkey", answer.alias("answer"), F.array_join(others, ",").alias("others"), question.alias("q"))
    return made.where(~F.contains("q", "answer"))


ATTRIBUTE = """
with w as (select p_partkey, regexp_extract_all(replace(lower(p_name), 'grey', 'gray'), '[a-z]+') as words from part),
h as (select *, list_filter(list_distinct(words), lambda x: list_contains(['red', 'blue', 'green', 'yellow', 'white', 'black', 'gray'], x)) as hits from w),
o as (select *, hits[1] as answer, list_filter(words, lambda x: not list_contains(hits, x)) as rest from h where len(hits) = 1),
q as (select *, rest[len(rest)] as noun from o)
select p_partkey, answer,
  array_to_string(list_transform(list_sort(list_transform(list_filter(['red', 'blue', 'green', 'yellow', 'white', 'black', 'gray'], lambda c: c <> answer), lambda c: {'h': substr(sha1(p_partkey || '|' || c), 1, 16), 'c': c}))[1:3], lambda x: x.c), ',') as others,
  'What colour ' || case when noun like '%s' and not regexp_matches(noun, '(ss|us|is)$') then 'are' else 'is' end || ' the ' || noun || '?' as q
from q where not contains('What colour ' || case when noun like '%s' and not regexp_matches(noun, '(ss|us|is)$') then 'are' else 'is' end || ' the ' || noun || '?', answer)"""


#: What the objects of an order are: words by the numbers of a part's brand and size.
LOOKS = (*rules.MATERIALS, "old", "shiny", "small", "round", "clean")


def material_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on what a line's part is made of, for the orders of the test split only: the family is held out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where(hashing.split_of(F.concat(F.lit("o_"), F.col("l_orderkey").cast("string"))) == "test")
    look = lambda n: F.element_at(F.array(*(F.lit(w) for w in LOOKS)), (n % len(LOOKS) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 11 == 0, "glass ").otherwise(""), F.col("p_name")).alias("name"), F.array(look(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")), look(F.col("p_size"))).alias("attributes"))
    objects = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    made = builders.attribute_questions(objects, "l_orderkey", "name", "attributes", rules.material, sorted(set(rules.MATERIALS.values())), list(rules.MATERIALS), "What ", " made of?")
    return made.select("l_orderkey", "answer", F.array_join("options", ",").alias("options"), "q")


_LOOKS = ", ".join(f"'{w}'" for w in LOOKS)
_STANDS = lambda e: f"case {e} " + " ".join(f"when '{a}' then '{m}'" for a, m in rules.MATERIALS.items()) + " end"
_BY_HASH = lambda e: f"substr(sha1(l_orderkey || '|' || {e}), 1, 16)"
MATERIAL = f"""
with o as (select l_orderkey, lower(trim(case when p_partkey % 11 = 0 then 'glass ' else '' end || p_name)) as name, [{_LOOKS}][regexp_extract(p_brand, '[0-9]+')::INT % {len(LOOKS)} + 1] as a, [{_LOOKS}][p_size % {len(LOOKS)} + 1] as b
  from lineitem join part on l_partkey = p_partkey where {split_of("'o_' || l_orderkey")} = 'test'),
m as (select l_orderkey, name, {_STANDS("a")} as x, {_STANDS("b")} as y, count(*) over (partition by l_orderkey, name) as n from o),
u as (select l_orderkey, name, coalesce(x, y) as answer from m where n = 1 and coalesce(x, y) is not null and coalesce(x = y, true)),
d as (select * from u qualify row_number() over (partition by l_orderkey order by {_BY_HASH("name")}, name) = 1),
p as (select *, list_sort(list_transform(list_filter([{", ".join(f"'{v}'" for v in sorted(set(rules.MATERIALS.values())))}], lambda v: v <> answer), lambda v: {{'h': {_BY_HASH("v")}, 'v': v}}))[1:3] as others from d)
select l_orderkey, answer, array_to_string(list_transform(list_sort(list_transform(list_append(list_transform(others, lambda x: x.v), answer), lambda v: {{'h': {_BY_HASH("'place|' || v")}, 'v': v}})), lambda x: x.v), ',') as options,
  'What ' || case when name like '%s' and not regexp_matches(name, '(ss|us|is)$') then 'are' else 'is' end || ' the ' || name || ' made of?' as q
from p where not list_has_any(regexp_extract_all(name, '[a-z]+'), [{", ".join(f"'{w}'" for w in rules.MATERIALS)}])"""


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return builders.cooccurrence(lines, "l_orderkey", "p_type")


def absent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return builders.absent_items(lines, "l_orderkey", "p_type").select("l_orderkey", F.array_join(F.array_sort("absent"), ",").alias("absent"))


_L = "with m as (select distinct l_orderkey, p_type from lineitem join part on l_partkey = p_partkey)"


def presence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a present kind and an absent one, the latter drawn by its co-occurrence with the present (hard)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    members = lines.select("l_orderkey", "p_type").distinct()
    key = (F.col("l_orderkey").cast("string"), F.col("p_type"))
    present = members.withColumn("rk", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(hashing.order_key(*key)))).where("rk = 1").select("l_orderkey", F.col("p_type").alias("present"))
    counts = builders.cooccurrence(lines, "l_orderkey", "p_type").select(F.col("a").alias("present"), F.col("b").alias("absent"), F.col("n").cast("double").alias("w"))
    absent = builders.absent_items(lines, "l_orderkey", "p_type").select("l_orderkey", F.explode("absent").alias("absent"))
    joined = absent.join(present, "l_orderkey").join(F.broadcast(counts), ["present", "absent"], "left")
    drawn = builders.weighted_pick(joined, "l_orderkey", 1 + F.coalesce("w", F.lit(0.0)), 1, F.col("l_orderkey").cast("string"), F.lit("neg"), F.col("absent"))
    return drawn.select("l_orderkey", "present", "absent")


PRESENCE = f"""{_L},
p as (select l_orderkey, p_type as present from m qualify row_number() over (partition by l_orderkey order by substr(sha1(l_orderkey || '|' || p_type), 1, 16)) = 1),
co as (select x.p_type as a, y.p_type as b, count(*) as n from m x join m y using (l_orderkey) group by 1, 2),
ab as (select o.l_orderkey, t.p_type as absent from (select distinct l_orderkey from m) o cross join (select distinct p_type from m) t anti join m on m.l_orderkey = o.l_orderkey and m.p_type = t.p_type)
select ab.l_orderkey, p.present, ab.absent from ab join p using (l_orderkey) left join co on co.a = p.present and co.b = ab.absent
qualify row_number() over (partition by ab.l_orderkey order by -ln({uniform("ab.l_orderkey || '|neg|' || ab.absent")}) / (1 + coalesce(co.n, 0))) = 1"""


def word_overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that share no word with any part name of the order (J20), by subtraction.

    Names have places in their order. Orders with equal sets of words are one set; the places that a set meets by a word are joined by
    equality, and the smallest place that it does not meet is the first free one. Names are small if the planner's sizes say so.
    """
    parts = table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", "p_name", text.words_of(F.col("p_name")).alias("words"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("own"))
    names = numbered(parts.groupBy("p_name").agg(F.min("words").alias("words")), ["p_name"], "place")
    sets = own.select("own").distinct()
    met = sets.select("own", F.explode("own").alias("word")).join(names.select("place", F.explode(F.array_distinct("words")).alias("word")), "word").select("own", "place").distinct()
    at = met.withColumn("at", F.row_number().over(Window.partitionBy("own").orderBy("place")))
    gaps = at.groupBy("own").agg(F.count(F.lit(1)).alias("met"), F.min(F.when(F.col("place") != F.col("at"), F.col("at"))).alias("gap"))
    free = sets.join(gaps, "own", "left").withColumn("met", F.coalesce("met", F.lit(0))).withColumn("place", F.coalesce("gap", F.col("met") + 1))
    left = free.join(names.select("place", F.col("p_name").alias("first_name")), "place").crossJoin(names.agg(F.count(F.lit(1)).alias("names")))
    return own.join(left.select("own", (F.col("names") - F.col("met")).alias("n"), "first_name"), "own").select("l_orderkey", "n", "first_name")


OVERLAP = """
with pool as (select distinct p_name, string_split(p_name, ' ') as words from part),
own as (select l_orderkey, list_distinct(flatten(list(string_split(p_name, ' ')))) as own from lineitem join part on l_partkey = p_partkey group by 1)
select l_orderkey, count(*) as n, min(p_name) as first_name from own join pool on not list_has_any(own.own, pool.words) group by 1"""

QUERIES = {f.__name__: f for f in (vote_spread_bool, split_by_hash, vote_spread_choice, vote_histogram_score, one_hot_targets, family_rules, supplier_crosswalk, hash_pick, unanswerable_filter, url_parse, unique_name_pairs, attribute_choice, material_questions, cooccurrence, absent_items, presence_pairs, word_overlap_exclusion)}
SQL = {
    "vote_spread_bool": VOTES,
    "split_by_hash": f"select doc_id, {split_of("'doc_' || doc_id")} as split, {h32("'doc_' || doc_id")} as h from documents",
    "vote_spread_choice": CHOICE,
    "vote_histogram_score": HISTOGRAM,
    "one_hot_targets": "select vec_id, array_to_string(list_transform(range(10), lambda i: case when i = label then '1' else '0' end), '') as target from embeddings where label between 0 and 9",
    "family_rules": FAMILY,
    "supplier_crosswalk": "select event_id, case when coalesce(s_nationkey, 0) <> 0 then format('coco_{:012d}', s_nationkey) when s_suppkey is not null then 'vg_' || user_id end as mapped from events left join supplier on s_suppkey = user_id",
    "hash_pick": f"select doc_id, ['How good is it?', 'Rate it.', 'What is its quality?'][{h32('doc_id::VARCHAR')} % 3 + 1] as q from documents",
    "unanswerable_filter": "select conv_id, turn, length(text) - length(replace(text, '?', '')) as marks from conversations where regexp_matches(lower(text), '^(is|are|the|in|of|on) ') and not regexp_matches(lower(text), '(^| )(what|which|how|why)( |$)') and length(text) - length(replace(text, '?', '')) <= 1",
    "url_parse": r"select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '/([a-z]{2})/', 1) as folder, regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1) as number from pages",
    "unique_name_pairs": PAIRS,
    "attribute_choice": ATTRIBUTE,
    "material_questions": MATERIAL,
    "cooccurrence": f"{_L} select x.p_type as a, y.p_type as b, count(*) as n from m x join m y using (l_orderkey) group by 1, 2",
    "absent_items": f"{_L} select l_orderkey, coalesce(array_to_string(list_sort(list_filter((select list(distinct p_type) from part), lambda t: not list_contains(list(p_type), t))), ','), '') as absent from m group by 1",
    "presence_pairs": PRESENCE,
    "word_overlap_exclusion": OVERLAP,
}
