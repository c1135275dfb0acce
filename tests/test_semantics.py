"""Goldens and properties: ties, splits, merges, divergences, folds, planted biases."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.functions import dist, hashing, rules, text
from quorum.operators import balance, calibration, integrate, metrics, stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hashes_equal_python(spark):
    keys = [f"coco_{k:012d}" for k in range(300)]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in frame.select("k", hashing.split_of(F.col("k")).alias("s"), hashing.h64(F.col("k")).alias("h"), hashing.order_key(F.col("k")).alias("o")).collect():
        hexes = hashlib.sha1(r.k.encode()).hexdigest()
        n = int(hexes[:8], 16) % 100
        assert r.s == ("train" if n < 90 else "val" if n < 95 else "test") and int(r.h) == int(hexes[:16], 16) and r.o == hexes[:16]


def test_split_does_not_depend_on_other_rows(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a = {r.k: r.s for r in frame.select("k", hashing.split_of(F.col("k")).alias("s")).collect()}
    b = {r.k: r.s for r in frame.where("id % 3 = 0").repartition(3).select("k", hashing.split_of(F.col("k")).alias("s")).collect()}
    assert all(a[k] == v for k, v in b.items())


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 8, 9])
def test_shifts_are_spread_half_even(n):
    r = min(n, 4)
    assert calibration.SHIFTS[n] == tuple(round(i * n / r) for i in range(r))


def test_distributions(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, dist.argmax(arr(0.4, 0.4, 0.2))) == 0
    p = one(spark, dist.softmax(arr(1, 2, 3), 2.0))
    e = [math.exp(x / 2) for x in (1, 2, 3)]
    assert p == pytest.approx([x / sum(e) for x in e])
    assert one(spark, dist.jensen_shannon(arr(1, 0), arr(0, 1))) == pytest.approx(math.log(2))
    assert one(spark, dist.jensen_shannon(arr(0.3, 0.7), arr(0.3, 0.7))) == pytest.approx(0)
    assert one(spark, dist.floored(F.array(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("-inf")), F.lit(-3.0)))) == [-100, -100, -100, -3]
    assert one(spark, dist.ranked_probability_score(arr(1, 0, 0), arr(0, 0, 1))) == pytest.approx(1)
    assert one(spark, dist.nll(arr(1, 0), arr(0, 1))) == pytest.approx(-math.log(1e-12))
    assert one(spark, dist.one_hot(4, F.lit(2))) == [0, 0, 1, 0]


def test_text_rules(spark):
    cases = [("unknown", "Is it?", True), ("no door", "What colour are the doors?", True), ("no parking", "What does the sign say?", False), ("none", "Which one?", False), (" Not Sure ", "q", True)]
    frame = spark.createDataFrame(cases, "o string, q string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", rules.is_denial(F.col("o"), F.col("q")).alias("got")).collect())
    assert one(spark, text.collapsed(F.lit(" a\t b\n\nc "))) == "a b c" and one(spark, text.opening(F.lit("  one two\tthree four five"))) == "one two three four"
    assert [one(spark, text.agreement(F.lit(w))) for w in ("cats", "glass", "bus", "dog")] == ["are", "is", "is", "is"]
    assert one(spark, text.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    families = {"Is the door open?": "open_closed", "Is it made of wood?": "material", "How many cats?": "count", "What colour is it?": "color", "Is there a dog?": "presence", "Why?": "other"}
    assert all(one(spark, rules.family(F.lit(q))) == f for q, f in families.items())


def test_denial_mass(spark):
    def moved(options, target, na, bad):
        t = F.lit(None).cast("array<double>") if target is None else F.array(*(F.lit(float(x)) for x in target))
        return one(spark, rules.move_mass(F.array(*map(F.lit, options)), t, F.lit(float(na)), F.array(*map(F.lit, bad))))

    r = moved(["a", "b", "no"], [0.3, 0.3, 0.4], 0.5, [False, False, True])
    assert r.options == ["a", "b"] and r.target == pytest.approx([0.5, 0.5]) and r.na == pytest.approx(0.7)
    r = moved(["a", "b", "no"], [0, 0, 1], 0, [False, False, True])
    assert r.target is None and r.na == 1.0
    assert moved(["a", "no"], [0.5, 0.5], 0, [False, True]) is None
    r = moved(["a", "b", "no"], None, 1.0, [False, False, True])
    assert r.options == ["a", "b"] and r.target is None and r.na == 1.0
    assert moved(["a", "b"], [0.5, 0.5], 0.1, [False, False]).na == 0.1


@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.booleans()), max_size=30))
def test_merge_rule_restated(rows):
    """The set-based rule against the sequential one, both in Python."""
    seen, want = set(), []
    for key, bad, held in rows:
        reason = "invalid" if bad else "duplicate" if key in seen else "held-out" if held else None
        want.append(reason)
        seen |= {key} if reason is None else set()
    first = {}
    for k, (key, bad, held) in enumerate(rows):
        if not bad and not held:
            first.setdefault(key, k)
    got = ["invalid" if bad else "duplicate" if first.get(key, len(rows)) < k else "held-out" if held else None for k, (key, bad, held) in enumerate(rows)]
    assert got == want


def test_merge_reasons_in_spark(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(6), rng.random() < 0.2, rng.random() < 0.3) for k in range(200)]
    frame = spark.createDataFrame(rows, "pos long, key int, bad boolean, held boolean").repartition(5)
    got = {r.pos: r.reason for r in integrate.merge_reasons(frame, ["key"], [F.col("pos")], F.when(F.col("bad"), "invalid"), F.col("held")).collect()}
    seen = set()
    for pos, key, bad, held in rows:
        want = "invalid" if bad else "duplicate" if key in seen else "held-out" if held else None
        seen |= {key} if want is None else set()
        assert got[pos] == want


def test_caps_change_little_when_rows_go(spark):
    frame = spark.range(400).select("id", (F.col("id") % 3).alias("g"))
    a = {r.id for r in integrate.bottom_k(frame, "g", 20, F.col("id").cast("string")).collect()}
    b = {r.id for r in integrate.bottom_k(frame.where("id >= 10"), "g", 20, F.col("id").cast("string")).collect()}
    assert len(a) == len(b) == 60 and len(a - b) <= 10


def test_metrics_identities(spark):
    rng = np.random.default_rng(0)
    rows = [(float(np.round(s, 1)), bool(p)) for s, p in zip(rng.random(200), rng.random(200) < 0.4, strict=True)]
    frame = spark.createDataFrame(rows, "s double, p boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    pairs = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.auroc(frame, F.col("s"), F.col("p")).first()["auroc"] == pytest.approx(pairs)
    assert metrics.auroc(frame.where("p"), F.col("s"), F.col("p")).first()["auroc"] is None
    assert metrics.auroc(frame, F.lit(1.0), F.col("p")).first()["auroc"] == 0.5
    exact = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "c double, a double")
    assert metrics.ece(exact, F.col("c"), F.col("a")).first()["ece"] == 0
    hundred = spark.range(100).withColumnRenamed("id", "v")
    assert metrics.ranked_value(hundred, "v", 0.95).first()["v"] == 95


def test_planted_letter_bias_is_recovered(spark):
    rng = np.random.default_rng(1)
    planted = np.array([0.4, 0.1, 0.0, -0.2, -0.3])
    rows = []
    for q in range(400):
        own = rng.normal(size=5)
        lp = []
        for shift in calibration.SHIFTS[5]:
            x = np.array([own[(pos + shift) % 5] + planted[pos] for pos in range(5)])
            lp.append((x - np.log(np.exp(x).sum())).tolist())
        rows.append((q, lp))
    long = calibration.long_readout(spark.createDataFrame(rows, "q long, lp array<array<double>>"), "q", "lp", 5)
    got = {r.pos: r.bias for r in calibration.letter_bias(long, "q").collect()}
    assert max(abs(got[k] - planted[k]) for k in range(5)) < 0.05


def test_balance_caps_and_prefers_dense_images(spark):
    rows = [(k, f"i{k % 7}", "big" if k < 60 else "small", k) for k in range(100)]
    frame = spark.createDataFrame(rows, "id long, image string, topic string, x long")
    density = frame.groupBy("image").agg(F.count(F.lit(1)).alias("density"))
    kept, left = balance.capped_groups(frame, "topic", "image", "id", 0.5, 100, density, "topic")
    counts = {r.topic: r["count"] for r in kept.groupBy("topic").count().collect()}
    assert counts == {"big": 50, "small": 40} and left.agg(F.sum("density")).first()[0] == 90
    dropped = {r.image for r in frame.join(kept, "id", "left_anti").collect()}
    densest = {r.image for r in density.where("density = 15").collect()}
    assert dropped <= densest


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 5), st.integers(1, 20))
def test_admission_keeps_its_promise(times, n, window):
    times = sorted(map(float, times))
    ok = stateful.admitted(times, n, window)
    accepted = []
    for t, a in zip(times, ok, strict=True):
        inside = sum(t - h <= window for h in accepted)
        assert a == (inside < n)
        accepted += [t] if a else []


@given(st.lists(st.integers(1, 40), max_size=40), st.integers(10, 90))
def test_batches_keep_to_the_budget(sizes, budget):
    sizes = sorted(sizes)
    number = stateful.batch_numbers(np.array(sizes, np.int64), budget).tolist()
    assert number == sorted(number)
    for a, b in zip(range(len(sizes)), range(1, len(sizes))):
        if number[a] != number[b]:  # the next one would not have fitted
            own = [s for s, k in zip(sizes, number, strict=True) if k == number[a]]
            assert max(*own, sizes[b]) * (len(own) + 1) > budget
    for b in set(number):
        own = [s for s, k in zip(sizes, number, strict=True) if k == b]
        assert len(own) == 1 or max(own) * len(own) <= budget


def test_quota_matches_its_weights():
    shares = np.array([0.5, 0.3, 0.2])
    ties = np.random.default_rng(1).integers(0, 1 << 60, (1000, 3)).astype(np.uint64)
    picks = stateful.fill_quotas(shares, ties, np.ones((1000, 3), bool))
    assert (abs(np.bincount(picks) / 1000 - shares) < 0.01).all()
    barred = np.arange(3)[None, :] != (np.arange(1000) % 4)[:, None]
    picks = stateful.fill_quotas(shares, ties, barred)
    assert all(k % 4 == 3 or p != k % 4 for k, p in enumerate(picks))
    assert stateful.accepted_texts(["a b c d e", "a b c d e", "a b c d f", "x"]) == [True, False, True, True]
    assert stateful.lru_hits([1, 2, 1, 3, 2, 1], 2) == [False, False, True, False, False, False]


def test_near_duplicate_pairs_equal_brute_force(spark):
    import random
    import re

    from quorum.operators import near_duplicates

    rng, rows = random.Random(3), []
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and"]
    for k in range(400):
        old = rng.choice(rows)[2] if rows and rng.random() < 0.6 else " ".join(rng.sample(words, rng.choice((1, 2, 4, 9, 40))))
        new = old.upper().split(" ")
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            new[rng.randrange(len(new))] = rng.choice(words)
        rows.append((k, rng.choice("ab"), " , ".join(new)))
    rows += [(900, "a", ""), (901, "a", "?!"), (902, "a", None), (903, None, "w1"), (None, "a", "w1")]
    got = near_duplicates.pairs(spark.createDataFrame(rows, "doc_id long, source string, text string"), "source", "doc_id", "text").collect()
    assert len({(r.doc_id_a, r.doc_id_b) for r in got}) == len(got)
    sets = {k: (g, frozenset(re.findall("[a-z0-9]+", t.lower()))) for k, g, t in rows if k is not None and g and t}
    sets = {k: v for k, v in sets.items() if v[1]}
    rep = {k: min(x for x in sets if sets[x] == sets[k]) for k in sets}
    want = {(rep[k], k, 1.0) for k in sets if rep[k] != k}
    for x in set(rep.values()):
        for y in set(rep.values()):
            (g, p), (h, q) = sets[x], sets[y]
            if x < y and g == h and len(p & q) / len(p | q) >= 0.8:
                want.add((x, y, round(len(p & q) / len(p | q), 6)))
    assert {(r.doc_id_a, r.doc_id_b, r.j) for r in got} == want and len(want) > 100
    assert any(j < 1 for *_, j in want)


def test_near_duplicate_documents_on_the_tables(spark):
    import re

    from quorum.plans import merge

    sf = "/root/testdata/sf0.01"
    docs = [(r.source, r.doc_id, frozenset(re.findall("[a-z0-9]+", r.text.lower()))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, j) for g, i, p in docs for h, j, q in docs if g == h and i < j and p and len(p & q) >= 0.8 * len(p | q)}
    got = {(r.doc_id_a, r.doc_id_b) for r in merge.near_duplicate_documents(spark, sf).collect()}
    assert got == want and got


def test_visible_turns_of_long_conversations(spark, tmp_path):
    from collections import Counter

    from quorum.plans import merge

    rows = [(c, t) for c, n in ((1, 8), (2, 41), (3, 90)) for t in range(n)] + [(2, 30), (2, 30), (2, 7), (4, 25), (4, 12), (4, 6), (5, None), (None, 3)]
    spark.createDataFrame(rows, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    blk = lambda t: 0 if t < 2 else t // 2
    want = Counter()
    for c, t in rows:
        for d, u in rows:
            if None not in (c, t, d, u) and c == d and u <= t and blk(u) in (0, blk(t), blk(t) // 2 if blk(t) > 1 else 0):
                want[c, t] += 1
    assert {(r.conv_id, r.turn): r.visible for r in merge.visibility_mask(spark, str(tmp_path)).collect()} == want


def test_shares_do_not_depend_on_the_size_of_the_table(spark, tmp_path):
    from quorum.plans import check

    langs = ["en"] * 1400 + ["de"] * 400 + ["fr"] * 130 + ["es"] * 70  # es has 3.5 per cent
    rows = [(k, x, "s", f"t{k % 100 if k < 1000 else k}") for k, x in enumerate(langs)]  # 100 texts ten times, others once
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in check.language_share_check(spark, str(tmp_path)).collect()] == [("languages of five per cent", 3.0, "FAIL")]
    assert [tuple(r) for r in check.source_top_share(spark, str(tmp_path)).collect()] == [("s", 0.25)]


def test_numbers_and_running_sums_over_ranges(spark):
    from quorum.operators import ordinal

    rows = [(f"k{(37 * k) % 500:03d}", k % 7) for k in range(500)]
    frame = spark.createDataFrame(rows, "h string, v long").repartition(5)
    got = sorted(tuple(r) for r in ordinal.numbered(frame, ["h"], "rn", F.col("v"), "sum").select("h", "rn", "sum").collect())
    want, total = [], 0
    for n, (h, v) in enumerate(sorted(rows), 1):
        total += v
        want.append((h, n, total))
    assert got == want
    assert ordinal.numbered(frame.limit(0), ["h"]).count() == 0
    sizes = [r["count"] for r in ordinal.micro_batches(frame, ["h"], 64).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [64] * 7 + [52]


def test_targets_and_floors(spark):
    from quorum.functions import dist, targets, text

    inf, nan = float("inf"), float("nan")
    [r] = spark.createDataFrame([([inf, -inf, nan, None, -3.0, -200.0],)], "lp array<double>").select(dist.floored(F.col("lp")).alias("x")).collect()
    assert r.x == [-100.0, -100.0, -100.0, -100.0, -3.0, -100.0]
    rows = spark.createDataFrame([([0.2, 0.3, 0.5], [0.5, 1.0]), ([0.0, 0.0, 1.0], None), ([0.0, 0.0, 0.4], [0.5, 0.5]), ([0.6, 0.2, 0.2], None)], "p array<double>, prior array<double>")
    got = [(r.x.target and [round(v, 6) for v in r.x.target], r.x.na) for r in rows.select(targets.target_of(F.col("p"), F.col("prior")).alias("x")).collect()]
    assert got == [([0.571429, 0.428571], 0.5), (None, 1.0), (None, 1.0), ([0.75, 0.25], 0.2)]
    words = ["none", "can't walk", "Cannot tell from here", " n/a ", "NOT visible", "unclear", "not a dog"]
    [r] = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", text.is_na_like).alias("x")).collect()
    assert r.x == [False, False, True, True, True, True, False]


def test_shown_numbers_round_ties_to_even(spark):
    values = [6 / 32, 13 / 32, 1 / 32, 0.12345, 0.00005, 1.0, 2 / 3]
    got = spark.createDataFrame([(values,)], "p array<double>").select(dist.shown(F.col("p"), 4)).first()[0]
    assert got == ",".join("%.4f" % v for v in values)


def test_fold_looks_up_accepted_texts(spark):
    """The same rows as by comparing each with all accepted ones, which are few of the pairs that it compares."""
    rng = random.Random(4)
    base = [" ".join(rng.choice("äbcdefghij") + str(rng.randrange(60)) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    made = [" ".join(w for w in rng.choice(base).split() if rng.random() > 0.08) + rng.choice(["", " Ä1", " more"]) for _ in range(500)]
    texts = [*base, *made, "", " ", "a b c d", "A  b c d e"]
    rng.shuffle(texts)
    rows = [(k, None if k % 3 == 0 else f"s{k % 3}", t) for k, t in enumerate(texts)]
    got = stateful.without_near_duplicates(spark.createDataFrame(rows, "id long, g string, t string"), "g", "id", "t")
    want = set()
    for g in (None, "s1", "s2"):
        own = [r for r in rows if r[1] == g]
        want |= {r[0] for r, ok in zip(own, stateful.accepted_texts([r[2] for r in own]), strict=True) if ok}
    assert {r.id for r in got.collect()} == want and 100 < len(want) < len(rows)
    held = stateful.Accepted(0.8)
    assert all(held.add(np.unique(np.random.default_rng(k).integers(0, 1 << 63, 50, dtype=np.uint64))) for k in range(300))
    assert max(len(x) for x in held.places.values()) < 5  # a new set meets those that share a rare word, not all of them


def test_accepted_sets_take_little_memory():
    """A set takes some bytes for each of its first words, not an entry of a dictionary; its words are on the disk."""
    import tracemalloc

    rng = np.random.default_rng(5)
    made = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(1500)]
    tracemalloc.start()
    held = stateful.Accepted(0.8)
    assert all(held.add(w) for w in made[:100])
    before = tracemalloc.get_traced_memory()[0]
    kept = [held.add(w) for w in made[100:]]
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert all(kept) and grown / len(kept) < 1500


def test_batches_of_accepted_sets_equal_brute_force():
    """Copies, chains of near copies and short sets of few words, within a batch and beyond it, in batches of any length."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    few = rng.integers(0, 1 << 63, 30, dtype=np.uint64)

    def made(kind: int) -> np.ndarray:
        if kind == 0:
            words = base.copy()
            words[rng.choice(len(words), int(rng.integers(0, 20)), replace=False)] = rng.integers(0, 1 << 63)
            return np.unique(words)
        return np.unique(rng.choice(few, 5) if kind == 1 else rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64))

    sets = [made(int(rng.integers(0, 3))) for _ in range(1200)]
    accepted, want = [], []
    for s in (set(s.tolist()) for s in sets):
        want.append(all(len(s & a) < 0.8 * len(s | a) for a in accepted))
        accepted += [s] if want[-1] else []
    for size in (1, 7, 512):
        held = stateful.Accepted(0.8)
        assert [ok for k in range(0, len(sets), size) for ok in held.extend(sets[k : k + size])] == want
    assert 300 < sum(want) < 1100
