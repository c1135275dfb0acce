"""Queries of integration: denials, validity, verdicts, manifests, duplicates, resumption, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, rules, text
from ..operators import increments, integrate
from ..operators import near_duplicates as near_duplicates_of
from ..operators.ordinal import numbered, zipped
from .common import h32, split_of, table

TYPES = ("click", "error", "purchase", "signup", "view")


def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the shares of event types, in the order of TYPES, as a choice question."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("event_type") == t).alias(t) for t in TYPES))
    return events.select("user_id", "n", F.array(*(F.lit(t) for t in TYPES)).alias("options"), F.array(*(F.col(t) / F.col("n") for t in TYPES)).alias("target"))


def denial_to_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'error' denies the premise: its mass moves into na."""
    d = _distributions(spark, sf_dir).withColumn("options", F.transform("options", lambda o: F.when(o == "error", "not sure").otherwise(o)))
    bad = F.transform("options", lambda o: rules.is_denial(o, F.lit("What did the user do?")))
    fixed = d.select("user_id", rules.move_mass(F.col("options"), F.col("target"), F.lit(0.0), bad).alias("f")).where("f is not null")
    return fixed.select("user_id", F.array_join("f.options", ",").alias("options"), F.round("f.na", 6).alias("na"), F.round(F.element_at("f.target", 1), 6).alias("p_click"), F.round(F.element_at("f.target", 4), 6).alias("p_view"))


DENIAL = """
with d as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as e, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v from events group by 1)
select user_id, 'click,purchase,signup,view' as options, case when n > e then round(e / n::DOUBLE, 6) else 1.0 end as na, round(case when n > e then c / (n - e)::DOUBLE end, 6) as p_click, round(case when n > e then v / (n - e)::DOUBLE end, 6) as p_view from d"""


def validity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from events, some of them broken by their numbers, and the first failing reason of each."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    options = F.when(i % 11 == 0, F.array(F.lit("a"))).when(i % 13 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    kind = F.when(i % 17 == 0, "rank").when(i % 3 == 0, "bool").when(i % 3 == 1, "choice").otherwise("score")
    na = F.when(i % 19 == 0, 1.5).when(i % 23 == 0, 1.0).otherwise(0.25)
    p = F.when(i % 29 == 0, 0.4).otherwise(0.5)
    target = F.when(i % 31 == 0, None).when(na == 1.0, None).when(kind == "score", F.array(p, p / 2, p / 2)).otherwise(F.array(p, F.lit(0.5)))
    keys = F.when(kind == "bool", F.array(F.lit("yes"), F.when(i % 37 == 0, "maybe").otherwise("no"))).otherwise(options)
    q = F.when(i % 41 == 0, " \t").otherwise("Is it?")
    label = F.when(i % 43 == 0, "guess").otherwise("exact")
    high = F.when(i % 47 == 0, 1).when(i % 53 == 0, 4).otherwise(3)
    return e.select(i.alias("event_id"), rules.problem(q, label, kind, na, options, keys, target, F.lit(1), high).alias("reason"))


VALIDITY = """
with q as (select event_id as i, case when i % 17 = 0 then 'rank' when i % 3 = 0 then 'bool' when i % 3 = 1 then 'choice' else 'score' end as kind,
  case when i % 19 = 0 then 1.5 when i % 23 = 0 then 1.0 else 0.25 end as na, case when i % 29 = 0 then 0.4 else 0.5 end as p from events),
r as (select *, (i % 31 = 0 or na = 1.0) as none from q)
select i as event_id, case when i % 41 = 0 then 'empty question' when i % 43 = 0 then 'bad label_kind' when na > 1 then 'bad na'
  when none <> (na = 1.0) then 'target must be null exactly when na = 1' when kind = 'rank' then 'unknown type rank'
  when kind = 'bool' and not none and i % 37 = 0 then 'bad bool target'
  when kind = 'choice' and (i % 11 = 0 or i % 13 = 0) then 'bad choice target'
  when kind = 'score' and (i % 47 = 0 or (not none and i % 53 = 0)) then 'bad score target'
  when none then null when p = 0.4 then 'target is not a distribution' end as reason from r"""


def either_or_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the verdict of their quality label: 0 drops, 1 tags, no label keeps."""
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    kept = integrate.with_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), verdicts, ["doc_id"], "ok")
    return kept.select("doc_id", F.coalesce("ok", F.lit(False)).alias("tagged"), text.is_either_or(F.col("text")).alias("either_or"))


def forced_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("forced")).distinct()
    split = hashing.split_of(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id").join(forced, "doc_id", "left").select("doc_id", F.when(F.col("forced"), "test").otherwise(split).alias("split"))


def manifest_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and sources have a manifest entry, and how many lack one."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))  # a repeated entry counts once
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(known, "doc_id", "left")
    return rows.groupBy(F.coalesce("known", F.lit(False)).alias("matched")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def manifest_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each customer, or else the priority of an order of theirs, as the later manifest."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    second = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v"))
    return integrate.last_wins(integrate.union_ranked([first, second]), "id", F.col("src_rank"), F.col("v")).select("id", "v", "src_rank")


def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of dropped documents, and of kept ones none: very short texts are invalid, Spanish is held out."""
    docs = table(spark, sf_dir, "documents").withColumn("key", text.dedup_key(F.col("text")))
    invalid = F.when(F.col("n_chars") < 40, "too short")
    reasons = integrate.merge_reasons(docs, ["source", "key"], [F.col("doc_id")], invalid, F.col("lang") == "es")
    return reasons.select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


MERGE = r"""
with d as (select doc_id, source, lang, n_chars, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
e as (select *, lower(t) as key, case when n_chars < 40 then 'too short' end as invalid, lang = 'es' as held from d),
f as (select *, coalesce(sum((invalid is null and not held)::int) over (partition by source, key order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from e)
select doc_id, case when invalid is not null then invalid when before > 0 then 'duplicate' when held then 'held-out' else 'kept' end as reason from f"""


def merge_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merge_dedup in two merges, the second against the keys that the first kept (D7): the halves of the documents by hash."""
    docs = table(spark, sf_dir, "documents").withColumn("key", text.dedup_key(F.col("text"))).withColumn("batch", hashing.h32(F.lit("merge"), F.col("doc_id").cast("string")) % 2)
    invalid, kept = F.when(F.col("n_chars") < 40, "too short"), increments.KeptKeys(spark)
    merge = lambda b: increments.merge_increment(docs.where(F.col("batch") == b), ["source", "key"], [F.col("doc_id")], invalid, F.col("lang") == "es", kept, b)
    both = merge(0).unionByName(merge(1))
    kept.drop()  # what the reasons need of it is checkpointed
    return both.select("doc_id", "batch", F.coalesce("reason", F.lit("kept")).alias("reason"))


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dedup(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrate.resume(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), done, ["o_orderkey"])


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers zipped by an explicit row number."""
    a = numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "row_id")
    b = numbered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "row_id")
    return a.join(b, "row_id").select("row_id", "s_suppkey", "n_name")


def readout_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by number beside readouts by label, as two outputs of one length that have no key in common."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    readouts = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("read_id"))
    return zipped(rows, readouts, ["vec_id"], ["label", "read_id"])


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversation turns of one role in one conversation whose sets of words have a Jaccard of 0.1 or more."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", words.alias("w"))
    both = t.alias("a").join(t.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.turn") < F.col("b.turn")))
    j = text.jaccard(F.col("a.w"), F.col("b.w"))
    return both.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.round(j, 6).alias("j")).where("j >= 0.1")


NEAR = """
with t as (select conv_id, role, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) as w from conversations)
select * from (select a.conv_id, a.turn as turn_a, b.turn as turn_b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE, 6) as j
from t a join t b on a.conv_id = b.conv_id and a.role = b.role and a.turn < b.turn) where j >= 0.1"""


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents of one source whose sets of words have a Jaccard of 0.8 or more, by classes of equal sets.

    A copy is a row with the smallest document of its class and 1; two classes are a row of their smallest documents. So the
    pairs are those of one class and those of two classes that have a row.
    """
    return near_duplicates_of.pairs(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def full_outer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and shipments of each day side by side; days with shipments come first in the order."""
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("v1"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("v2"))
    joined = a.join(b, "day", "full_outer").withColumn("without", F.col("v2").isNull())
    placed = numbered(joined, ["without", "day"], "place")
    return placed.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "v1", "v2", (F.coalesce("v2", F.lit(0)) - F.coalesce("v1", F.lit(0))).alias("delta"), "place")


def first_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase's value of each user, attached to the user's other events."""
    events = table(spark, sf_dir, "events")
    first = integrate.first_wins(events.where("event_type = 'purchase'"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", F.col("value").alias("first_value"))
    return events.where("event_type = 'error'").join(first, "user_id", "left").select("event_id", "first_value")


def calibration_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the temperature and bias of their type, from a small table that owns each type once."""
    own = spark.createDataFrame([("click", 1.5, 0.25), ("view", 0.8, -0.5), ("error", 2.0, 0.0), ("purchase", 1.25, 0.125), ("signup", 0.5, -0.25)], "event_type string, t double, bias double")
    return table(spark, sf_dir, "events").join(F.broadcast(integrate.owned_once(own, "event_type")), "event_type").select("event_id", F.round(F.col("value") / F.col("t") + F.col("bias"), 6).alias("scaled"))


def visibility_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns see which: an earlier one of the same conversation in the prefix, the same block or its parent.

    Blocks follow each other, so the prefix and the parent are seen whole from later blocks: their sizes are counted, and in the
    turn's own block those up to it. A repeated turn counts each time; rows without a conversation or turn see nothing.
    """
    return integrate.visible_turns(table(spark, sf_dir, "conversations"))


PATTERNS = (("negation", "(^| )(not|no|nicht|pas)( |$)"), ("conjunction", "(^| )(and|und|et|y)( |$)"), ("article", "(^| )(the|der|die|das|le|la|el)( |$)"), ("number", "[0-9]"), ("licence", "licen[sc]e"), ("mark", "!!"), ("pipe", "[|]"), ("question", "[?]"), ("mail", "@"))


def topic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language how many documents match each of nine patterns: one pass, conditional counts."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(low.rlike(p)).alias(name) for name, p in PATTERNS))


def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to orders to customers to nations: large sides by key, small ones broadcast by their size."""
    lines, orders, customers, nations = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def json_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column, and its serialised pair with the type."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), k.alias("k"))).alias("j"))


def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns nested by conversation in order and taken apart again (K2, A1)."""
    t = F.struct("turn", "role", F.length("text").alias("n"))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))
    return nested.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.turn", "t.role", F.col("t.n").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (denial_to_na, validity_reasons, either_or_verdicts, forced_test_split, manifest_join_missing, manifest_overlay, merge_dedup, merge_increments, merge_counts, semi_filter, anti_resume, positional_zip, readout_zip, near_duplicates, near_duplicate_documents, full_outer_days, first_wins_lookup, calibration_by_type, visibility_mask, topic_matrix, dimension_joins, json_scalar, nested_round_trip)}
SQL = {
    "denial_to_na": DENIAL,
    "validity_reasons": VALIDITY,
    "either_or_verdicts": "select d.doc_id, coalesce(l.quality = 1, false) as tagged, regexp_matches(d.text, '[0-9A-Za-z_] or [0-9A-Za-z_]') as either_or from documents d left join labels l using (doc_id) where coalesce(l.quality = 1, true)",
    "forced_test_split": f"select d.doc_id, case when l.doc_id is not null then 'test' else {split_of("'doc_' || d.doc_id")} end as split from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1",
    "manifest_join_missing": "select l.doc_id is not null as matched, count(*) as n, count(distinct source) as sources from documents d left join labels l using (doc_id) group by 1",
    "manifest_overlay": "select * from (select c_custkey as id, c_mktsegment as v, 0 as src_rank from customer union all select o_custkey, o_orderpriority, 1 from orders) qualify row_number() over (partition by id order by src_rank desc, v desc) = 1",
    "merge_dedup": MERGE,
    "merge_increments": MERGE.replace("select doc_id, source,", f"select doc_id, {h32("'merge|' || doc_id")} % 2 as batch, source,").replace("order by doc_id rows", "order by batch, doc_id rows").replace("select doc_id, case", "select doc_id, batch, case"),
    "merge_counts": f"select reason, count(*) as n from ({MERGE}) group by 1",
    "semi_filter": "select o_orderstatus, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1",
    "anti_resume": "select o_orderkey, o_orderpriority from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "positional_zip": "select row_id, s_suppkey, n_name from (select s_suppkey, row_number() over (order by s_suppkey) as row_id from supplier) join (select n_name, row_number() over (order by n_nationkey) as row_id from nation) using (row_id)",
    "readout_zip": "select * from (select vec_id, row_number() over (order by vec_id) as row_id from embeddings) join (select label, vec_id as read_id, row_number() over (order by label, vec_id) as row_id from embeddings) using (row_id)",
    "near_duplicates": NEAR,
    "full_outer_days": "select strftime(day, '%Y-%m-%d') as day, v1, v2, coalesce(v2, 0) - coalesce(v1, 0) as delta, row_number() over (order by v2 is null, day) as place from (select o_orderdate::DATE as day, count(*) as v1 from orders group by 1) full join (select l_shipdate::DATE as day, count(*) as v2 from lineitem group by 1) using (day)",
    "first_wins_lookup": "select e.event_id, f.value as first_value from events e left join (select user_id, value from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts, event_id) = 1) f using (user_id) where e.event_type = 'error'",
    "calibration_by_type": "select event_id, round(value / t + bias, 6) as scaled from events join (values ('click', 1.5::DOUBLE, 0.25::DOUBLE), ('view', 0.8, -0.5), ('error', 2.0, 0.0), ('purchase', 1.25, 0.125), ('signup', 0.5, -0.25)) o(event_type, t, bias) using (event_type)",
    "visibility_mask": "with t as (select conv_id, turn, case when turn < 2 then 0 else turn // 2 end as blk from conversations where turn < 12), u as (select *, case when blk > 1 then blk // 2 else 0 end as parent from t) select a.conv_id, a.turn, count(*) as visible from u a join u b on a.conv_id = b.conv_id and b.turn <= a.turn and (b.blk = 0 or b.blk = a.blk or b.blk = a.parent) group by 1, 2",
    "topic_matrix": "select lang, count(*) as n, " + ", ".join(f"count(*) filter (regexp_matches(lower(text), '{p}')) as {n}" for n, p in PATTERNS) + " from documents group by 1",
    "dimension_joins": "select n_name, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "json_scalar": """select event_id, (props->>'$.k')::INT as k, '{"t":"' || event_type || '","k":' || (props->>'$.k') || '}' as j from events""",
    "nested_round_trip": "select conv_id, (row_number() over (partition by conv_id order by turn, role, length(text)) - 1)::INT as pos, turn, role, length(text) as n from conversations",
}
