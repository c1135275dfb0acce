"""Queries of written questions: all reasons to reject them, and the acceptance checks that need them or calibrated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, written
from . import calibrate, reports
from .common import evaluated, table

#: Topics and their families; the first is taken for a topic that was not asked for.
TOPICS = {"shape": "shape", "made of": "material", "colour": "color", "number": "count"}

#: Requests and what was written for them, as expressions that both engines read, in steps.
_STEPS = (
    {"i": "p_partkey", "m": "p_partkey % 29", "n": "p_name", "kind": "case p_partkey % 3 when 0 then 'choice' when 1 then 'bool' else 'score' end"},
    {
        "asked": """case when m = 2 then 'tell me about ' || n when m = 3 then 'is it' when m = 4 then 'what is ' || repeat(n || ' ', 40) when m = 13 and kind = 'bool' then 'are there any ' || n || 's here'
            when kind = 'choice' then case when m = 18 then 'what metal part is ' else 'what  kind of ' end || n || ' . ' when kind = 'bool' then case when m = 22 then 'is the ' || n || ' old or new' else 'does the ' || n || 's  turn' end else 'how clean is the ' || n end""",
        "topic": "case when m in (17, 19) then 'made of' when m % 4 = 0 then 'colour' when m % 4 = 1 then 'number' when m % 4 = 2 then 'weather' else 'shape' end",
        "options": """case when m = 5 then '"' || n || '", " ' || upper(n) || '."' when m = 6 then '"alpha", "Not sure", "gamma"' when m = 7 then '"alpha", "one two three four five six seven", "gamma"'
            when m = 8 then '"alpha", "Maybe", "gamma"' when m = 9 then '"alpha", "kind of", "gamma"' when m = 24 then '"alpha", "no ' || n || '", "gamma"' when m = 25 then '"alpha", "no kinds", "gamma"' else '"alpha ray", "beta.", " Gamma  two "' end""",
        "k": "case when m = 5 then 2 when m = 10 then 4 else 3 end",
        "anchors": """case when m = 11 then '"low_label": " ", "high_label": "x"' when m = 12 then '"low_label": "Same", "high_label": " same"' else '"low_label": "Dirty ", "high_label": "clean"' end""",
        "absent": "m in (13, 14, 15, 23)",
        "thing": "case when m = 14 then 'zebra' when m = 15 then '' else n end",
        "held": "m = 19",
        "old": "case when m = 20 then 'what kind of ' || n || ', does the ' || n || 's turn' when m = 21 then 'How clean is the ' || n || '?' else 'Where is it?' end",
        "old2": "case when m = 20 then 'Does the ' || n || 's turn?' when m = 26 then 'What kind of ' || n || '?' else '' end",
    },
    {"raw": """case when m = 0 then '{broken' when m = 1 then '{"skip": true}' else '{"question": " ' || asked || '", "topic": "' || topic || '", "options": [' || options || '], ' || anchors || ', "absent_thing": "' || thing || '"}' end"""},
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").repartition("p_partkey")  # few bytes and much work a row: files are not cut that fine
    for step in _STEPS:
        rows = evaluated(rows, **{k: F.expr(e) for k, e in step.items()})
    return rows


def judged(rows: DataFrame, topics: dict[str, str] = TOPICS) -> DataFrame:
    """Records of written questions with ``reason``, null where they are accepted (P25).

    ``rows`` has raw, kind, k (options wanted), absent and held (of the request), and existing (questions of the same image).
    """
    kind, j, q = F.col("kind"), F.col("j"), F.col("q")
    made = evaluated(evaluated(rows, j=written.parsed(F.col("raw"))), q=written.question(F.col("j.question"), kind), opts=written.options(F.col("j.options")), low=written.anchor(F.col("j.low_label")), high=written.anchor(F.col("j.high_label")))
    names = F.create_map(*(F.lit(x) for kv in topics.items() for x in kv))
    about = F.when(F.col("j.topic").isin(*topics), F.col("j.topic")).otherwise(next(iter(topics)))
    made = evaluated(made, about=about, family=F.element_at(names, about))
    kept_apart = F.col("family").isin(*rules.HELD_OUT) | rules.family(q).isin(*rules.HELD_OUT)
    form, choice, absence = written.form_problem(kind, q), F.when(kind == "choice", written.options_problem(q, F.col("opts"), F.col("k"))), F.when(F.col("absent"), written.absence_problem(q, j["absent_thing"]))
    flat = (kind == "score") & ((F.col("low") == "") | (F.col("high") == "") | (F.col("low") == F.col("high")))
    rest = F.when(flat, "anchors")
    late = F.when(~F.col("held") & kept_apart, "held-out family").when(written.repeats(q, F.col("existing")), "near duplicate")
    unread = F.when(j["unreadable"].isNotNull() | j.isNull(), "not json").when(j["skip"], "skipped")
    return evaluated(made, reason=F.coalesce(unread, form, choice, rest, absence, late)).drop("j")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_requests(spark, sf_dir).withColumn("existing", F.array("old", "old2")))


def written_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written questions as records, or the first of thirteen reasons to reject them."""
    fine = lambda c: F.when(F.col("reason").isNull(), c)
    kind = F.col("kind")
    return _judged(spark, sf_dir).select(
        "p_partkey", "kind", "reason", fine(F.col("q")).alias("q"), fine(F.col("family")).alias("family"),
        fine(F.when(kind == "choice", F.array_join("opts", "|"))).alias("options"),
        fine(F.when(kind == "score", F.concat_ws("|", "low", "high"))).alias("anchors"),
        fine((kind == "bool") & text.is_either_or(F.col("q"))).alias("to_check"),
    )


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_collapsed = lambda e: rf"regexp_replace(regexp_replace({e}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_words = lambda e: f"regexp_extract_all(lower({e}), '[a-z0-9]+')"
_stem = lambda w: f"case when {w} like '%es' and length({w}) >= 5 then left({w}, -2) when {w} like '%s' and length({w}) >= 4 then left({w}, -1) else {w} end"
_FAMILY = "case " + " ".join(f"when regexp_matches(lower(q), {_quoted(p)}) then '{n}'" for n, p in rules.FAMILIES) + " else 'other' end"
_DENIED = ", ".join(_quoted(d) for d in rules.DENIALS)
_HELD = ", ".join(_quoted(h) for h in rules.HELD_OUT)
_FROM = "part"
for _step in _STEPS:
    _FROM = f"(select *, {', '.join(f'{e} as {k}' for k, e in _step.items())} from {_FROM})"
JUDGED = rf"""
r as (select *, json_valid(raw) as readable, case when json_valid(raw) then raw else '{{}}' end as j from {_FROM}),
a as (select *, {_collapsed("coalesce(j->>'$.question', '')")} as c, coalesce(j->>'$.topic', '') as t, lower({_collapsed("coalesce(j->>'$.low_label', '')")}) as low, lower({_collapsed("coalesce(j->>'$.high_label', '')")}) as high,
  list_transform(coalesce(from_json(j->'$.options', '["VARCHAR"]'), []), lambda o: regexp_replace(lower({_collapsed("o")}), '^[ .]+|[ .]+$', '', 'g')) as opts from r),
b as (select *, upper(c[1]) || substr(c, 2) as cc from a),
d as (select *, case when kind = 'score' or cc like '%?' then cc else regexp_replace(cc, '[ .]+$', '') || '?' end as q, case t when 'made of' then 'material' when 'colour' then 'color' when 'number' then 'count' else 'shape' end as family from b),
e as (select *, {_words("q")} as w, {_words("coalesce(j->>'$.absent_thing', '')")} as tw, {_FAMILY} as own_family from d),
f as (select *, list_transform(w, lambda x: regexp_replace(x, 's+$', '')) as sw, list_transform(regexp_extract_all(lower(q), '[a-z]+'), lambda x: {_stem("x")}) as stems from e),
judged as (select *, case when not readable then 'not json' when j->>'$.skip' = 'true' then 'skipped'
  when kind = 'choice' and not regexp_matches(q, {_quoted(written.CHOICE_START)}) or kind = 'bool' and not regexp_matches(q, {_quoted(written.BOOL_START)}) then 'form'
  when length(q) not between 12 and 200 then 'length'
  when kind = 'choice' and (len(opts) <> k or list_contains(opts, '') or len(list_distinct(list_transform(opts, lambda o: array_to_string({_words("o")}, ' ')))) <> len(opts)) then 'options'
  when kind = 'choice' and len(list_filter(opts, lambda o: regexp_matches(o, {_quoted(text.NA_LIKE)}) or o in ({_DENIED}) or len(string_split(o, ' ')) > 6
    or (regexp_matches(o, '^no [a-z]+$') and list_contains(stems, {_stem("substr(o, 4)")})))) > 0 then 'evasive option'
  when kind = 'choice' and list_has_any(opts, ['yes', 'no', 'maybe', 'uncertain']) then 'hedging option'
  when kind = 'choice' and len(list_filter(opts, lambda o: length(o) >= 3 and list_has_all(w, {_words("o")}))) > 0 then 'answer in question'
  when kind = 'score' and (low = '' or high = '' or low = high) then 'anchors'
  when absent and (len(tw) = 0 or not (list_contains(w, tw[-1]) or list_contains(sw, tw[-1]))) then 'nothing presupposed'
  when absent and regexp_matches(q, {_quoted(written.PRESENCE)}) then 'asks for presence'
  when not held and (family in ({_HELD}) or own_family in ({_HELD})) then 'held-out family'
  when len(list_filter([{_words("old")}, {_words("old2")}], lambda x: len(x) > 0 and len(w) > 0 and len(list_intersect(x, w)) >= 0.8::DOUBLE * len(list_distinct(list_concat(x, w))))) > 0 then 'near duplicate' end as reason from f)"""
WRITTEN = rf"""with {JUDGED}
select p_partkey, kind, reason, case when reason is null then q end as q, case when reason is null then family end as family, case when reason is null and kind = 'choice' then array_to_string(opts, '|') end as options,
  case when reason is null and kind = 'score' then low || '|' || high end as anchors, case when reason is null then kind = 'bool' and regexp_matches(q, '{text.WORD_OR_WORD}') end as to_check from judged"""


def verdicts(frame: DataFrame, **checks: tuple[Column, float | None, float | None]) -> DataFrame:
    """(name, value, status) of several checks over one frame, from one aggregation: MISSING without a value, else by the bounds."""
    one = frame.agg(*(F.round(v.cast("double"), 6).alias(n) for n, (v, _, _) in checks.items()))

    def row(name: str, low: float | None, high: float | None) -> Column:
        v = F.col(name)
        inside = (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True))
        return F.struct(F.lit(name.replace("_", " ")).alias("name"), v.alias("value"), F.when(v.isNull(), "MISSING").when(inside, "PASS").otherwise("FAIL").alias("status"))

    return one.select(F.inline(F.array(*(row(n, low, high) for n, (_, low, high) in checks.items()))))


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance checks beyond acceptance_checks (M12): options, scales, topics, calibration, positions, stability, held-out sets and leaks."""
    ok = _judged(spark, sf_dir).where("reason is null")
    choice, bare = F.col("kind") == "choice", F.lower("q")
    opts = F.filter("opts", lambda o: choice & text.is_na_like(o))
    own = rules.family(F.col("q"))
    leaks = F.exists("opts", lambda o: choice & (F.length(o) >= 3) & F.contains(bare, o))
    upper = F.aggregate(F.filter("opts", lambda o: F.substring(o, 1, 1).rlike("[A-Z]")), F.lit(0), lambda n, o: n + 1)
    # one pass over the questions: a row for each topic
    found = ok.groupBy("about").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(opts) > 0).alias("na"), F.sum(F.when(choice, upper)).alias("upper"), F.sum(F.when(choice, F.size("opts"))).alias("options"),
        F.count_if(own == "open_closed").alias("closed"), F.count_if((F.col("family") == "material") | (own == "material")).alias("material"), F.count_if(leaks).alias("leaks"),
    )
    of_all = lambda c: F.coalesce(F.sum(c), F.lit(0))
    first = verdicts(
        found,
        options_like_na=(of_all("na"), None, 0),
        uppercase_options=(F.sum("upper") / F.sum("options"), None, 0.05),
        topics=(F.count("about"), 25, None),
        held_out_open_closed=(of_all("closed"), 2500, None),
        held_out_material=(of_all("material"), 2500, None),
        answers_in_questions=(of_all("leaks"), None, 0),
        largest_topic=(F.max("n") / F.sum("n"), None, 0.08),
    )
    scales = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    scales = scales.crossJoin(scales.agg(F.sum("n").alias("total")))
    by_type, of = reports.per_type_report(spark, sf_dir), lambda c, t: F.max(F.when(F.col("type") == t, F.col(c)))
    parts = [
        verdicts(scales, scales_of_eight_per_cent=(F.count_if(F.col("n") * 100 >= F.col("total") * 8), 5, None)),
        verdicts(by_type, calibration_error_0=(of("ece", "0"), None, 0.05), calibration_error_1=(of("ece", "1"), None, 0.05), calibration_error_2=(of("ece", "2"), None, 0.05), ranking_of_na=(of("auroc", "na"), 0.95, None)),
        verdicts(reports.position_deviation(spark, sf_dir), position_deviation=(F.max("deviation"), None, 0.03)),
        verdicts(calibrate.aggregated(spark, sf_dir).where("stability <= 0.2"), rotation_stability=(F.max("stability"), None, 0.2)),
    ]
    for p in parts:
        first = first.unionByName(p)
    return first


_CHECKS = (
    ("options like na", "select count(*) filter (kind = 'choice' and len(list_filter(opts, lambda o: regexp_matches(o, " + _quoted(text.NA_LIKE) + "))) > 0) as value from ok", None, 0),
    ("uppercase options", "select sum(len(list_filter(opts, lambda o: regexp_matches(o, '^[A-Z]')))) filter (kind = 'choice') / (sum(len(opts)) filter (kind = 'choice'))::DOUBLE as value from ok", None, 0.05),
    ("topics", "select count(distinct case when t in ('made of', 'colour', 'number') then t else 'shape' end) as value from ok", 25, None),
    ("held out open closed", "select count(*) filter (own_family = 'open_closed') as value from ok", 2500, None),
    ("held out material", "select count(*) filter (family = 'material' or own_family = 'material') as value from ok", 2500, None),
    ("answers in questions", "select count(*) filter (kind = 'choice' and len(list_filter(opts, lambda o: length(o) >= 3 and contains(lower(q), o))) > 0) as value from ok", None, 0),
    ("largest topic", "select max(n) / sum(n)::DOUBLE as value from (select count(*) as n from ok group by case when t in ('made of', 'colour', 'number') then t else 'shape' end)", None, 0.08),
    ("scales of eight per cent", "select count(*) filter (n * 100 >= s * 8) as value from (select count(*) as n, sum(count(*)) over () as s from orders group by o_orderpriority)", 5, None),
    *((f"calibration error {k}", f"select max(ece) filter (type = '{k}') as value from report", None, 0.05) for k in range(3)),
    ("ranking of na", "select max(auroc) as value from report", 0.95, None),
    ("position deviation", f"select max(deviation) as value from ({reports.POSITIONS})", None, 0.03),
    ("rotation stability", f"select max(stability) as value from ({calibrate.CALIBRATED})", None, 0.2),
)
_bounds = lambda lo, hi: " and ".join([*([f"v >= {lo}"] if lo is not None else []), *([f"v <= {hi}"] if hi is not None else [])])
ANSWERS = f"with {JUDGED}, ok as (select * from judged where reason is null), report as ({reports.REPORT})" + " union all ".join(
    f" select '{n}' as name, v as value, case when v is null then 'MISSING' when {_bounds(lo, hi)} then 'PASS' else 'FAIL' end as status from (select round(value::DOUBLE, 6) as v from ({q}))" for n, q, lo, hi in _CHECKS
)

QUERIES = {f.__name__: f for f in (written_rules, answer_checks)}
SQL = {"written_rules": WRITTEN, "answer_checks": ANSWERS}
