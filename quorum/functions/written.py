"""Rules over written questions: from JSON to a record, or the first reason to reject it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, text

SCHEMA = "skip boolean, question string, topic string, options array<string>, low_label string, high_label string, absent_thing string, unreadable string"

#: The first words of a choice and of a yes/no question, what asks for presence, and answers that hedge.
CHOICE_START = r"^(What|Which|Where|How|Who|Whose|When|Why|In|On|At|From|Approximately|Roughly) "
BOOL_START = r"^(Is|Are|Was|Were|Does|Do|Did|Can|Could|Has|Have|Had|Will|Would|Should|May|Might) "
PRESENCE = r"^(Is|Are) there\b|^(Can|Do|Does) (you|we|one) see\b"
HEDGES = ("yes", "no", "maybe", "uncertain")


def parsed(raw: Column) -> Column:
    """The written fields; ``unreadable`` holds what is no such JSON."""
    return F.from_json(raw, SCHEMA, {"columnNameOfCorruptRecord": "unreadable"})


def tokens(of: Column) -> Column:
    return F.regexp_extract_all(F.lower(of), F.lit("([a-z0-9]+)"), F.lit(1))


def question(asked: Column, kind: Column) -> Column:
    """Capitalised, in single spaces and, but for scores, with a question mark."""
    q = text.capitalised(text.collapsed(F.coalesce(asked, F.lit(""))))
    return F.when((kind == "score") | q.endswith("?"), q).otherwise(F.concat(F.regexp_replace(q, "[ .]+$", ""), F.lit("?")))


def options(given: Column) -> Column:
    return F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda o: F.regexp_replace(F.lower(text.collapsed(F.coalesce(o, F.lit("none")))), "^[ .]+|[ .]+$", ""))


def anchor(label: Column) -> Column:
    return F.lower(text.collapsed(F.coalesce(label, F.lit(""))))


def inside(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def form_problem(kind: Column, q: Column) -> Column:
    start = F.when(kind == "choice", q.rlike(CHOICE_START)).when(kind == "bool", q.rlike(BOOL_START)).otherwise(True)
    return F.when(~start, "form").when(~F.length(q).between(12, 200), "length")


def options_problem(q: Column, found: Column, wanted: Column) -> Column:
    """Of a choice: number and distinctness, statements of N/A and long options, hedges, options that the question gives away."""
    keys = F.transform(found, lambda o: F.array_join(tokens(o), " "))
    whole = (F.size(found) == wanted) & (F.size(F.array_distinct(keys)) == F.size(found)) & ~F.array_contains(found, "")
    evasive = lambda o: text.is_na_like(o) | rules.is_denial(o, q) | (F.size(F.split(o, " ")) > 6)
    given_away = lambda o: (F.length(o) >= 3) & inside(tokens(o), tokens(q))
    return (
        F.when(~F.coalesce(whole, F.lit(False)), "options")
        .when(F.exists(found, evasive), "evasive option")
        .when(F.arrays_overlap(found, F.array(*(F.lit(h) for h in HEDGES))), "hedging option")
        .when(F.exists(found, given_away), "answer in question")
    )


def absence_problem(q: Column, thing: Column) -> Column:
    """Of a question about something absent: it must presuppose the thing (its last word, or a plural of it), not ask whether it is there."""
    singular = F.transform(tokens(q), lambda w: F.regexp_replace(w, "s+$", ""))
    last = F.try_element_at(tokens(F.coalesce(thing, F.lit(""))), F.lit(-1))
    meant = F.array_contains(tokens(q), last) | F.array_contains(singular, last)
    return F.when(~F.coalesce(meant, F.lit(False)), "nothing presupposed").when(q.rlike(PRESENCE), "asks for presence")


def repeats(q: Column, existing: Column, least: float = 0.8) -> Column:
    """Whether a question's set of words is near that of an existing one."""
    own = tokens(q)
    return F.coalesce(F.exists(existing, lambda e: text.jaccard(own, tokens(e)) >= least), F.lit(False))
