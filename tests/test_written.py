"""Written questions: each reason, repairs and cases."""

import json

from pyspark.sql import functions as F

from quorum.functions import written
from quorum.plans.written import judged

GOOD = {"question": "what  kind of boat is this .", "topic": "shape", "options": [" Sail ", "row.", "tug"]}
CASES = [
    (None, "choice", False, False, "not json"),
    ("[1", "choice", False, False, "not json"),
    ('{"skip": true}', "choice", False, False, "skipped"),
    ({**GOOD, "question": None}, "choice", False, False, "form"),
    ({**GOOD, "question": "Is it a boat"}, "choice", False, False, "form"),
    ({**GOOD, "question": "Is it"}, "bool", False, False, "length"),
    ({**GOOD, "question": "Is it " + "long " * 40}, "bool", False, False, "length"),
    ({**GOOD, "options": ["a b", "A  b.", "c"]}, "choice", False, False, "options"),
    ({**GOOD, "options": ["sail", "", "c"]}, "choice", False, False, "options"),
    ({**GOOD, "options": None}, "choice", False, False, "options"),
    ({**GOOD, "options": ["sail", "n/a", "c"]}, "choice", False, False, "evasive option"),
    ({**GOOD, "options": ["sail", "no boats", "c"]}, "choice", False, False, "evasive option"),
    ({**GOOD, "options": ["sail", "no wind", "c"]}, "choice", False, False, None),
    ({**GOOD, "options": ["sail", "uncertain", "c"]}, "choice", False, False, "hedging option"),
    ({**GOOD, "options": ["sail", "boat kind", "c"]}, "choice", False, False, "answer in question"),
    (GOOD, "score", False, False, "anchors"),
    ({**GOOD, "low_label": "Low", "high_label": "high"}, "score", False, False, None),
    (GOOD, "choice", True, False, "nothing presupposed"),
    ({**GOOD, "absent_thing": "red boat"}, "choice", True, False, None),
    ({**GOOD, "question": "Are there two boats here", "absent_thing": "boat"}, "bool", True, False, "asks for presence"),
    ({**GOOD, "topic": "made of"}, "choice", False, False, "held-out family"),
    ({**GOOD, "topic": "made of"}, "choice", False, True, None),
    ({**GOOD, "question": "Where is the old tug boat now"}, "choice", False, False, "answer in question"),
    ({**GOOD, "question": "Is the old boat in port today"}, "bool", False, False, "near duplicate"),
    (GOOD, "choice", False, False, None),
]


def test_every_reason(spark):
    rows = [(k, raw if raw is None or isinstance(raw, str) else json.dumps(raw), kind, 3, absent, held, ["Is the old boat in port?", None, ""]) for k, (raw, kind, absent, held, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "id int, raw string, kind string, k int, absent boolean, held boolean, existing array<string>")
    got = {r.id: r for r in judged(frame).collect()}
    assert [got[k].reason for k in range(len(CASES))] == [c[-1] for c in CASES]
    last = got[len(CASES) - 1]
    assert last.q == "What kind of boat is this?" and last.opts == ["sail", "row", "tug"] and last.about == "shape"
    assert judged(frame.limit(0)).count() == 0


def test_question_marks(spark):
    frame = spark.createDataFrame([("is it . .", "bool"), ("is it?", "bool"), ("rate it.", "score"), ("", "choice")], "a string, kind string")
    assert [r.q for r in frame.select(written.question(F.col("a"), F.col("kind")).alias("q")).collect()] == ["Is it?", "Is it?", "Rate it.", "?"]


def test_questions_are_judged_in_one_pass(spark):
    """A filter on the reason does not bring in again what it is made of: the JSON is read once in the plan."""
    from quorum.plans import written

    def parsed(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("from_json")

    sf = "/root/testdata/sf0.001"
    assert parsed(written._judged(spark, sf).where("reason is null")) == 1
    assert parsed(written.answer_checks(spark, sf)) == 1
