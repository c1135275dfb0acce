import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quorum.llm.collocations import LONGEST, PART, Shard, _sieve, _stretches, collocations, hashes, intervals, suffixes


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(texts):
    got = Counter()
    for t in texts:
        for ws in pieces(t):
            got.update(tuple(ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    return got


def brute(rows, least, top):
    out = []
    for lang in {x or "und" if x is None else x for x, _ in rows}:
        f = counts(t for x, t in rows if (x if x is not None else "und") == lang)
        n = sum(v for p, v in f.items() if len(p) == 1)
        big = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in big.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(100 * b >= 80 * a and inside(q) for q, b in big.items() if len(q) > len(p)):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    phrases = ["new york", "New York city", "of the", "the", "été à la plage", "a\tb", "\x1cctl", "in. order", "日本 語 です", "x", "y z", "\xa0nbsp", "a a a a a"]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice([" ", "  ", ". ", "\n"]).join(rng.choice(phrases) for _ in range(rng.randrange(25)))) for _ in range(150)]
    return [*rows, *rows[:5], ("en", None), ("de", ""), ("", "alone here " * 9), ("en", "hot words " * 20000), (None, "ends."), ("fr", " \t ")]


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "`l.ang` string, text string, phrase string, n long")


@pytest.mark.parametrize(("words", "bits", "top"), [(1 << 21, 27, 2000), (300, 8, 7)])
def test_collocations_equal_brute_force(spark, words, bits, top):
    got = collocations(made(spark, corpus()), least=5, top=top, lang_col="l.ang", words=words, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == brute(corpus(), 5, top)
    assert got


def test_empty_tables(spark):
    assert collocations(made(spark, []), lang_col="l.ang").count() == 0
    assert collocations(made(spark, [("en", None), (None, "one two")]), lang_col="l.ang").count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("abB .\t\n"), max_size=30), max_size=6), st.sampled_from([2, 4]))
def test_intervals_are_phrase_counts(texts, depth):
    shard = Shard()
    for t in texts:
        shard.add(t)
    ids, spelled = shard.ids(), list(shard.number)
    at = np.flatnonzero(ids)
    sa, lcp = suffixes(ids, at, depth)
    room = np.array([next(m for m in range(LONGEST + 1) if m == LONGEST or ids[i + m] == 0) if i + LONGEST < len(ids) else 0 for i in range(len(ids))])
    got = {}
    for m in range(1, depth + 1):
        place, n = intervals(sa, lcp, room, m)
        for i, c in zip(place, n, strict=True):
            phrase = tuple(spelled[w].decode() for w in ids[i : i + m])
            assert phrase not in got
            got[phrase] = c
    assert got == {p: c for p, c in counts(texts).items() if len(p) <= depth}
    assert shard.words == sum(c for p, c in got.items() if len(p) == 1)


@pytest.mark.parametrize(("least", "bits"), [(3, 27), (40, 27), (3, 9)])
def test_hashes_travel_by_parts_of_the_bit_map(least, bits):
    texts = [" ".join(f"w{k}" for k in range(20_000))] * 2 + [" ".join(f"w{k}" for k in range(0, 20_000, 50))] * least
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    sent = list(_sieve(15_000, None, 0, least, bits)(iter([batch])))
    assert sum(b.num_rows for b in sent) <= 1 << PART  # not one for each of the hashes
    got = _stretches(least, bits)(pa.Table.from_batches(sent))
    marks = dict(zip(np.frombuffer(got["cells"][0].as_py(), np.uint64).tolist(), np.frombuffer(got["ones"][0].as_py(), np.uint64).tolist(), strict=True))
    shard = Shard()
    for t in texts:
        shard.add(t)
    want, (one, two) = Counter(), hashes(shard, "en", ids := shard.ids(), 2)
    inside = ids[: -LONGEST] > 0
    for h in [*one[inside], *two[inside & (ids[1 : 1 - LONGEST] > 0)]]:
        want[int(h) & ((1 << 40) - 1)] += 1
    bits_set = {(c << 6) + k for c, x in marks.items() for k in range(64) if x >> k & 1}
    assert bits_set == {h & ((1 << bits) - 1) for h, n in want.items() if n >= least} and bits_set
