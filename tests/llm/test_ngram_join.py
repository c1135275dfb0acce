import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.llm import ngram_join, queries_corpus
from quorum.llm.components import components
from quorum.llm.shared import staged

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, per_cent):
    """(size, component, links) of each row, by comparing each with each."""
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[root(k)] += [i] if i is not None else []
    return [(i, len(sets[k]), min(members[root(k)], default=None), links[k]) for k, (i, _) in enumerate(rows)]


def copies(seed, n, words):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(words)] = f"e{rng.randrange(90)}"
        out.append(" ".join(t))
    return out


def corpus():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "one two", "One Two", "a b c", "A\tb\nc", "é ñ ü", "É ñ ü"]
    for seed, (n, words) in enumerate([(30, 60), (12, 14), (9, 220), (6, 9), (5, 1500), (40, 130)]):
        texts += copies(seed, n, words)
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(3, 90))) for _ in range(60)]
    passage = " ".join(f"p{k}" for k in range(55))
    texts += [passage + " " + " ".join(f"z{rng.randrange(9000)}" for _ in range(70)) for _ in range(15)]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    return [*rows, rows[0], (None, texts[20]), (None, None)]


@pytest.mark.parametrize(("width", "per_cent", "block"), [(3, 90, 1500), (5, 80, 7), (2, 60, 11)])
def test_join_equals_brute_force(spark, width, per_cent, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, __row_key string, `mark.` string")
    docs = staged(docs.repartition(3), "test")
    got = ngram_join.join(docs, width, per_cent, block=block)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(brute(rows, width, per_cent), key=key)
    assert got.where("first").count() == got.where("n_shingles > 0").select("component_id").distinct().count() + got.where("n_shingles = 0").count()
    kept = ngram_join.deduplicate(docs, width, per_cent, block=block)
    assert kept.columns == docs.columns and kept.count() == got.where("first").count()
    if per_cent == 80:
        assert ngram_join.join(docs.limit(0)).count() == 0 and ngram_join.deduplicate(docs.limit(0)).count() == 0


def test_large_families_of_many_sizes_and_frequent_tokens(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[: 100 + 3 * k]) for k in range(100)]  # a chain of sizes: neighbours link, both ends do not
    texts += [" ".join(f"f{rng.randrange(30)}" for _ in range(12)) for _ in range(80)]
    rows = list(enumerate(texts))
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "chain")
    got = ngram_join.join(docs, 1, 70, block=9)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(brute(rows, 1, 70))
    with pytest.raises(ValueError):
        ngram_join.join(docs, 1, 0)


def test_deduplicate_refuses_rows_that_change(spark, monkeypatch):
    docs = staged(spark.createDataFrame([(k, "a b c d e f g") for k in range(6)], "doc_id long, text string"), "same")
    monkeypatch.setattr(ngram_join, "_mark", lambda i, t, n=iter(range(9)): F.lit(next(n)).cast("long"))
    with pytest.raises(Exception, match="not the same in two passes"):
        ngram_join.deduplicate(docs).collect()


def test_partitions_may_change_between_passes(spark, tmp_path, monkeypatch):
    """As they do where an executor comes or goes: the number of cores decides how files are cut and dealt."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(40)]
    rows = list(enumerate([*texts, *(t + " more" for t in texts), *texts[:9]]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs, made = spark.read.parquet(str(tmp_path / "docs")), ngram_join.staged

    def later(frame, name):
        done = made(frame, name)
        if name in ("shingles", "copies"):
            spark.conf.set("spark.sql.files.openCostInBytes", "64m" if name == "shingles" else "1k")
        return done

    monkeypatch.setattr(ngram_join, "staged", later)
    for use in (ngram_join.join, ngram_join.deduplicate):
        spark.conf.set("spark.sql.files.openCostInBytes", "1k" if use is ngram_join.join else "64m")
        try:
            got = use(docs, 1, 80).collect()
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        want = brute(rows, 1, 80)
        assert sorted(tuple(r)[:4] for r in got) == sorted(want) if use is ngram_join.join else len(got) == len({c for _, _, c, _ in want})


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries_corpus.op1_ngram_join(spark, SF).collect())
    assert got == sorted(brute(rows, 3, 90))
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(duckdb.sql(queries_corpus.SQL["op1_ngram_join"]).fetchall())


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 400), st.data())
def test_similar_sets_share_a_signature(n, data):
    """The promise of the prefixes: any pair at or above the threshold meets by a combination."""
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    per_cent = data.draw(st.sampled_from([50, 60, 70, 80, 90, 95]))
    base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    other = base[rng.random(len(base)) > rng.random() * (1 - per_cent / 100) * 1.3]
    other = np.unique(np.concatenate([other, rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 10) + 1)), dtype=np.uint64)]))
    inter, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
    if len(other) and 100 * inter >= per_cent * union and union > inter:
        edges = ngram_join.size_classes(-(-100 // (100 - per_cent)) - 1)
        ext = [ngram_join.extended_prefix(x, per_cent, edges[0]) for x in (base, other)]
        assert len(np.intersect1d(*ext)) >= max(max(1, -(-per_cent * len(x) // 100) // 10) for x in (base, other))
        assert len(np.intersect1d(*(ngram_join.wide_signatures(x, per_cent, edges) for x in (base, other))))
        (s1, c1), (s2, c2) = (ngram_join.signatures(x, per_cent, edges) for x in (base, other))
        assert len(np.intersect1d(c1, c2)) and len(np.intersect1d(s1, s2))


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(-5, 300), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140)) and all(got[200 + k] == 200 for k in range(9)) and got[299] == got[300] == -5
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lane_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 1 << 63, 4, dtype=np.uint64)]))
        similar = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        rows.append((len(a), *map(int, ngram_join.lanes(a)), len(b), *map(int, ngram_join.lanes(b)), similar))
    names = [f"{s}_{c}" for s in "ab" for c in ("n", *ngram_join.COUNTS)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names) + ", similar boolean")
    assert frame.where("similar").where(~ngram_join._near(90)).count() == 0 and frame.where("similar").count() > 5
    assert frame.select(F.count_if(F.col("similar"))).first()[0]
