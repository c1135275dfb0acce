import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorum.llm.divergence import audit, excess, group_slices, shard_counts, term_slices

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [m.translate({c: c + 32 for c in range(65, 91)}) for m in TERM.findall(text or "")]


def brute(rows, least, top):
    """All rows by nested loops over (lang, source, text)."""
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= least]
        groups = {s: Counter(t for r in rows if r[:2] == (lang, s) for t in r[2]) for s in {r[1] for r in rows if r[0] == lang}}
        total = {t: sum(c[t] for c in groups.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in groups.items()}, p(total)
        for s in groups:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            own = sorted((q[t] - share[s][t], t.encode(), t) for t in kept if groups[s][t] and share[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(own[:top], 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "`a.lang` string, source string, text string, term string, n long, docs long")


def corpus():
    rng = random.Random(1)
    words = ["the", "The", "of", "naïve", "ÉTÉ", "été", "日本", "x", "it's", "a1b", "\x7fdel", "nul\x00l", "zz", "aa", "_u_", "ß"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "É", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("xx", f"s{k}", "rare words") for k in range(3)] + [("xx", "s9", None), ("yy", "alone", ""), ("en", "hot", "the " * 50000)]
    return rows + rows[:9]


@pytest.mark.parametrize(("entries", "tile"), [(1 << 20, 256), (7, 2)])
def test_audit_equals_brute_force(spark, entries, tile):
    got = audit(made(spark, corpus()), lang_col="a.lang", least=4, top=3, entries=entries, tile=tile).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(corpus(), 4, 3)


def test_empty_table_and_no_kept_terms(spark):
    assert audit(made(spark, []), lang_col="a.lang").count() == 0
    got = audit(made(spark, [("en", "a", "one"), ("en", "b", None)]), lang_col="a.lang").collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]


@given(st.lists(st.text(alphabet=st.sampled_from("aAzZ@[`{é日\x7f\x80 \n'1"), max_size=12), max_size=8))
def test_boundaries(texts):
    data = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    low, begins, ends = term_slices(np.frombuffer(data, np.uint8), offsets)
    assert [low[a:b].tobytes().decode() for a, b in zip(begins, ends, strict=True)] == [t for x in texts for t in terms(x)]
    group, code, names, n, docs = shard_counts(pa.array(texts, pa.string()), np.arange(len(texts)) % 2)
    want = {(k % 2, t.encode()) for k, x in enumerate(texts) for t in terms(x)}
    assert {(g, names[c]) for g, c in zip(group, code, strict=True)} == want and len(group) == len(want)
    for g, c, many, held in zip(group, code, n, docs, strict=True):
        own = [Counter(terms(x))[names[c].decode()] for k, x in enumerate(texts) if k % 2 == g]
        assert (many, held) == (sum(own), sum(x > 0 for x in own))


@pytest.mark.parametrize("digest", [len, lambda b: 0, lambda b: b[0]])
def test_colliding_hashes_are_told_apart(digest):
    words = b"one two one six ten two oh one oh".split()
    data, at = b" ".join(words), 0
    begins, ends = [], []
    for w in words:
        begins.append(at)
        ends.append(at + len(w))
        at += len(w) + 1
    code, names = group_slices(np.frombuffer(data, np.uint8), np.array(begins), np.array(ends), digest)
    assert [names[c] for c in code] == words and len(set(names)) == len(names)


@settings(max_examples=60)
@given(st.integers(1, 6), st.integers(0, 5), st.integers(1, 6), st.randoms())
def test_excess_equals_dense_sums(sources, n, tile, rng):
    absent = np.array([rng.randrange(20) for _ in range(sources)])
    dense = np.repeat(absent[:, None], n, axis=1)
    cells = [(t, s) for t in range(n) for s in range(sources) if rng.random() < 0.5]
    for t, s in cells:
        dense[s, t] = rng.randrange(40)
    entries = [np.array([x[k] for x in cells], int) for k in (0, 1)]
    got = dict(excess(0, absent, tile, *entries, np.array([dense[s, t] for t, s in cells], int)))
    assert set(got) == set(range(min(tile, sources - 1)))
    for a, sums in got.items():
        assert sums.tolist() == [int(sum(abs(dense[a] - dense[b]) - abs(absent[a] - absent[b]))) for b in range(a + 1, sources)]
