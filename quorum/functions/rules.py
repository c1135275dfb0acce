"""Rules over questions: premise denials, validity, families, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dist, text

#: Options that deny a question's premise.
DENIALS = ("unknown", "unclear", "not sure", "not possible", "cannot tell", "can't tell", "cannot determine", "can't determine", "none of the above")

#: How far the sum of a target may be from one.
TOLERANCE = 1e-3

#: Kinds of labels.
LABEL_KINDS = ("exact", "human_soft", "teacher_soft")

#: Ordered patterns of question families; those held out come first.
FAMILIES = (
    ("open_closed", r"\b(open|opened|closed|shut)\b"),
    ("material", r"\b(made of|made from|material|wooden|wood|metal|metallic|plastic|glass|leather|ceramic|steel|concrete|brick|stone|cotton|wool|paper|cardboard)\b"),
    ("count", r"\b(how many|two|three|four|five|six|seven|eight|nine|ten|\d+)\b"),
    ("color", r"\b(colou?rs?|red|blue|green|yellow|white|black|brown|orange|pink|purple|gr[ae]y|silver|gold)\b"),
    ("presence", r"^(is|are) there\b"),
)
HELD_OUT = ("open_closed", "material")
#: Words for materials and the material that each stands for.
MATERIALS = {
    "wooden": "wood", "wood": "wood", "metal": "metal", "metallic": "metal", "plastic": "plastic", "glass": "glass", "brick": "brick", "leather": "leather",
    "concrete": "concrete", "cement": "concrete", "stone": "stone", "paper": "paper", "ceramic": "ceramic", "cloth": "fabric", "fabric": "fabric",
}


def material(attribute: Column) -> Column:
    """The material that an attribute stands for, null for any other attribute."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in MATERIALS.items() for x in kv)), F.lower(text.stripped(attribute)))


def family(question: Column) -> Column:
    return text.first_family(question, list(FAMILIES))


def is_denial(option: Column, question: Column) -> Column:
    """Whether an option denies the premise: one of the fixed ones, or "no X" where the question is about X."""
    o = F.lower(text.stripped(option))
    noun = F.regexp_extract(o, r"^no ([a-z]+)$", 1)
    about = F.transform(text.words_of(question), text.stem)
    return o.isin(*DENIALS) | ((noun != "") & F.array_contains(about, text.stem(noun)))


def move_mass(options: Column, target: Column, na: Column, bad: Column) -> Column:
    """struct(options, target, na) without the bad options, their mass moved into na; null if fewer than two remain.

    ``bad`` is an array of booleans. If no mass is left, or na reaches one, the target is null and na is one.
    """
    p = F.coalesce(target, F.transform(options, lambda o: F.lit(0.0)))
    kept = F.filter(F.arrays_zip(options.alias("o"), p.alias("p"), bad.alias("b")), lambda x: ~x["b"])
    moved = dist.total(F.zip_with(target, bad, lambda p, b: F.when(b, p).otherwise(0.0)))
    rest = dist.total(F.transform(kept, lambda x: x["p"]))
    new_na = na + (1 - na) * moved
    alive = (rest > 0) & (new_na < 1)
    new = F.when(alive, F.transform(kept, lambda x: x["p"] / rest))
    changed = F.struct(F.transform(kept, lambda x: x["o"]).alias("options"), new.alias("target"), F.when(alive, new_na).otherwise(1.0).alias("na"))
    same = F.struct(options.alias("options"), target.alias("target"), na.alias("na"))
    without = F.struct(F.transform(kept, lambda x: x["o"]).alias("options"), F.lit(None).cast("array<double>").alias("target"), na.alias("na"))
    return F.when(~F.exists(bad, lambda b: b), same).when(F.size(kept) < 2, None).when(target.isNull(), without).otherwise(changed)


def problem(q: Column, label_kind: Column, kind: Column, na: Column, options: Column, keys: Column, target: Column, low: Column, high: Column) -> Column:
    """The first reason why a question is invalid, or null. ``keys`` are the target's labels (bool, choice)."""
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    none = target.isNull()
    shape = (
        F.when(kind == "bool", none | same(keys, F.array(F.lit("yes"), F.lit("no"))))
        .when(kind == "choice", (F.size(options) >= 2) & (F.size(F.array_distinct(options)) == F.size(options)) & (none | same(keys, options)))
        .when(kind == "score", (high > low) & (none | (F.size(target) == high - low + 1)))
    )
    return (
        F.when(q.isNull() | (text.stripped(q) == ""), "empty question")
        .when(label_kind.isNull() | ~label_kind.isin(*LABEL_KINDS), "bad label_kind")
        .when(na.isNull() | ~na.between(0.0, 1.0), "bad na")
        .when(none != (na == 1.0), "target must be null exactly when na = 1")
        .when(kind.isNull() | ~kind.isin("bool", "choice", "score"), F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("none"))))
        .when(~F.coalesce(shape, F.lit(False)), F.concat(F.lit("bad "), kind, F.lit(" target")))
        .when(none, None)
        .when((F.array_min(target) < 0) | (F.abs(dist.total(target) - 1) > TOLERANCE), "target is not a distribution")
    )


def cap_group(source: Column, prefix: str) -> Column:
    """Sources that share a prefix share one cap."""
    return F.when(source.startswith(prefix), prefix).otherwise(source)


def flags(**named: Column) -> Column:
    """The names of the conditions that hold, in the given order."""
    return F.filter(F.array(*(F.when(c, n) for n, c in named.items())), lambda x: x.isNotNull())


def shown(labels: Column, p: Column, least: float = 0.01) -> Column:
    """"label n%" of all labels with at least ``least``, the likeliest first."""
    pairs = F.array_sort(F.transform(F.arrays_zip(labels.alias("l"), p.alias("p")), lambda x: F.struct((-x["p"]).alias("less"), x["l"].alias("l"))))
    return F.array_join(F.transform(F.filter(pairs, lambda x: -x["less"] >= least), lambda x: F.format_string("%s %d%%", x["l"], F.round(-x["less"] * 100).cast("int"))), ", ")


def request_problem(kind: Column, q: Column, options: Column, low: Column, high: Column) -> Column:
    """The first reason why a requested question is refused, or null: its type, text, options (blank ones are ignored) or scale."""
    given = F.filter(F.transform(options, text.stripped), lambda o: o != "")
    distinct = F.size(F.array_distinct(F.transform(given, F.lower))) == F.size(given)
    fine = (F.size(given).between(2, 8)) & distinct & (F.array_max(F.transform(given, F.length)) <= 60)
    return (
        F.when(kind.isNull() | ~kind.isin("bool", "choice", "score"), "type")
        .when(~F.coalesce(F.length(text.stripped(q)).between(1, 300), F.lit(False)), "text")
        .when((kind == "choice") & ~F.coalesce(fine, F.lit(False)), "options")
        .when((kind == "score") & ~F.coalesce((low >= 0) & (low < high) & (high <= 10), F.lit(False)), "scale")
    )


def anchors_or_ends(anchors: Column, low: Column, high: Column) -> Column:
    """Both anchors of a scale, cut to forty characters, or its ends where there are not exactly two."""
    given = F.filter(F.transform(anchors, lambda a: F.substring(text.stripped(a), 1, 40)), lambda a: a != "")
    return F.when(F.size(given) == 2, given).otherwise(F.array(low.cast("string"), high.cast("string")))
