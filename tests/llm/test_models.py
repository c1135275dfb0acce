import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorum.llm import html_text, nearest, quality, queries_corpus, secrets, toxicity

SF = "/root/testdata/sf0.01"


def brute_base(text):
    words = text.encode().split()
    marked = set()
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for starts in seen.values():
        if len(starts) > 1:
            marked |= {k + j for k in starts for j in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


EDGE = ["", " \n\t", "a", "a " * 9, "a b c d e f g h " * 3, "x\ny\nx\n\nx", "é ñ ü #*$", "\x1c\x1d a", "same line here\n" * 40, "w " * 30000]


def test_base_numbers_equal_brute_force():
    rng = random.Random(1)
    for t in EDGE + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]:
        assert quality.measure(t.encode())[0] == brute_base(t), repr(t[:40])


def test_forest_is_monotonic_and_flat_scoring_agrees():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.random(800) - 0.8 * x[:, 1] > 0.2).astype(float)
    f = quality.fit(x, y, monotone=(1, -1, 0), trees=25)
    probe = np.tile(rng.random((1, 3)), (50, 1))
    for k, sign in ((0, 1), (1, -1)):
        p = probe.copy()
        p[:, k] = np.linspace(0, 1, 50)
        assert (sign * np.diff(f.score(p)) >= -1e-12).all()

    def walk(row):
        total = f.prior
        for t in range(len(f.value)):
            n = 0
            while f.left[t, n] != n:
                n = f.left[t, n] if row[f.feature[t, n]] <= f.threshold[t, n] else f.right[t, n]
            total += f.value[t, n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:40]), [walk(r) for r in x[:40]])
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries_corpus.op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute_base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)
    right = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == (y == 1) for k, y in right]) > 0.97


def small(spark, texts):
    return spark.createDataFrame([(k, t, True, 0.5, 1) for k, t in enumerate(texts)] + [(None, "x y", True, 0.5, 1)], "doc_id long, text string, kept boolean, score double, predicted int")


def test_samples_are_bounded_in_rows_and_names_may_clash(spark):
    docs = spark.createDataFrame([(1, f"text {k} of one id", True, "a", 1) for k in range(5000)] + [(k, f"clean words {k}", True, "b", 1) for k in range(2, 40)], "doc_id long, text string, kept boolean, `odd.name` string, __text int")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)] * 3, "doc_id long, quality int, toxic int")
    assert quality.labelled_sample(docs, labels, "toxic", 10, "doc_id", "text").count() == 10
    assert sorted(r.text for r in quality.labelled_sample(docs.where("doc_id < 3"), labels, "toxic", 100, "doc_id", "text").collect()) == ["clean words 2", "text 0 of one id"]
    for operator, model in ((quality, quality.train(docs, labels)), (toxicity, toxicity.train(docs, labels))):
        judged = operator.assess(docs, model, keep=docs.columns)
        assert judged.columns[:5] == docs.columns and len(set(judged.columns)) == len(judged.columns) and judged.count() == 5038
        assert operator.passing(docs, model).columns == docs.columns
    assert toxicity.passing(docs, None).count() == 5038 and quality.passing(docs, None).count() == 0  # under twenty words
    long = spark.createDataFrame([(1, "idiot " * 200_000), (1, "idiot " * 200_000)], "doc_id long, text string")
    assert toxicity.assess(long, toxicity.train(docs, labels)).count() == 2


def test_models_without_labels_and_edge_rows(spark):
    docs, none = small(spark, [*EDGE, None]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None and toxicity.train(docs, none) is None
    got = quality.assess(docs, None)
    assert got.count() == len(EDGE) + 2 and got.where("kept and n_words < 20").count() == 0
    assert toxicity.assess(docs, None).where("score = 0 and predicted = 0").count() == len(EDGE) + 2
    assert quality.assess(docs.limit(0), None).count() == 0 and toxicity.assess(docs.limit(0), None).count() == 0
    kept = quality.assess(docs, None, keep=docs.columns[:2])
    assert kept.columns[:2] == ["doc_id", "text"]


def test_kernel_table_equals_the_double_sum():
    """The folded table against a direct sum over common subsequences of two units."""
    from itertools import combinations

    def features(u):
        out = {}
        for order, span in toxicity.SPANS:
            for at in combinations(range(len(u)), order):
                if at[-1] - at[0] < span:
                    key = "".join(u[k] for k in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    marks, some = ["\x02idiot\x03", "\x02scum\x03"], ["\x02id*iot\x03", "\x02banana\x03", "\x02xyzzy\x03", "\x02scumm\x03"]
    kernel = toxicity._Kernel(marks, "".join(sorted(set("".join(marks)))))
    machine = toxicity.Machine(kernel.reader.alphabet, kernel.folded(np.array([0.5, -2.0])), 0.25, np.zeros(4))
    assert np.allclose(machine.decide(some), kernel.rows(some) @ [0.5, -2.0] + 0.25, atol=1e-5)
    for row, u in zip(kernel.rows(some), some, strict=True):
        for value, m in zip(row, marks, strict=True):
            a, b = features(u), features(m)
            want = sum(a[k] * b.get(k, 0) for k in a) / toxicity.REACH[len(u)] / toxicity.REACH[len(m)]
            assert value == pytest.approx(want, abs=1e-6)


def test_toxicity_tolerates_gaps_and_holds_out():
    rng = random.Random(4)
    clean = ["the", "of", "erand", "thion", "lyest", "handor", "ingea", "onthe", "stand", "reti", "whound"]
    insults = ["idiot", "scum", "pathetic", "worthless"]

    def text(bad):
        words = [rng.choice(clean) + rng.choice(clean) for _ in range(40)]
        for w in bad:
            words[rng.randrange(40)] = w
        return " ".join(words) + "."

    train = [(text(rng.sample(insults, 2)), 1) for _ in range(60)] + [(text([]), 0) for _ in range(200)]
    m = toxicity.fit(train, landmarks=80)
    score = lambda t: m.score(toxicity._decisions(m, "t", [toxicity.units(t)])[0])
    assert all(score(text([w])) > 0.5 for w in insults)
    assert sum(score(text([])) > 0.5 for _ in range(60)) <= 1
    assert score(text(["id.iot"])) > score(text([])) and score(text(["i d i o t"])) > 0.5
    assert score("") < 0.5 and score("1 2 3") < 0.5


def test_toxicity_query_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries_corpus.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = np.mean([np.mean([(b > g) + 0.5 * (b == g) for g in good]) for b in bad])
    assert auc > 0.9 and np.mean([s >= 0.7 for s in good]) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div><!-- c -->
<div class="ad big">Buy now, much text here to tempt the density of the line, really long</div>
<article><header><h1>A &amp; B</h1></header><p><b>First
  line<br>goes &lt;on&gt;<p>Second &#233;<ul><li>one<li>two</ul><form>Name <input><button>Go</button></form><p>Short.</p><div class="comments"><p>A reader's comment</p></div></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "A & B\nFirst line goes <on>\nSecond é\none\ntwo\nShort."
    for size in (1, 7, 100):
        assert html_text.main_text(PAGE, piece=size) == html_text.main_text(PAGE)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("plain text") == "plain text"
    assert html_text.main_text("<div class=nav>x</div><div id=main><p>Hello there<p>again</div>") == "Hello there\nagain"
    assert html_text.main_text("<p>" * 3000 + "deep" + "<div>" * 500 + "er") == "deep\ner"


def test_html_hints_and_inline_markup():
    long = [f"Sentence {k} of the text, which goes on for quite a while to be dense." for k in range(8)]
    text = html_text.main_text
    body = "".join(f"<p>{x}</p>" for x in long)
    assert text(f'<nav>Home</nav><div id="main" class="content has-sidebar">{body}</div>').split("\n") == long
    assert text(f'<div class="sidebar">{body}</div>').split("\n") == long  # the only text of the page
    assert text(f'<form class="widget"><article>{body}</article></form>').split("\n") == long
    inside = '<section class="related-work"><p>Earlier work.</p></section><p class="side-effects">Side effects.</p><div class="related-posts"><p>Read also</p></div>'
    assert text(f"<article>{body}{inside}</article>").split("\n") == [*long, "Earlier work.", "Side effects."]
    assert text(f"<article>{long[0]}</article><div class=sidebar>{body}</div><div id=comments>{body * 3}</div>") == long[0]
    assert text(f"<p>{long[0]}</p><div class='comment-list'><article>{body}</article></div>") == long[0]
    assert text('<article><p>One <span class="ad">Buy <span>now</span> cheap offer</span> two <button>x</button>three</p></article>') == "One two three"
    assert text('<article><p>One <span class="ad"><div>x</div></span> two</p></article>') == "One two"
    assert text("<p>a\x0bb\u2003c&nbsp;d <script>var x = '<p>';</script>e</p>") == "a b c d e"
    assert text("</i></p>" * 50_000 + "<b>" * 50_000 + "x") == "x"
    assert text("<span class=ad>all</span>") == "all"


def test_html_unclosed_containers_and_large_hinted_sections():
    long = [f"Sentence {k} of the text, which goes on for quite a while to be dense." for k in range(8)]
    text, body = html_text.main_text, "".join(f"<p>{x}</p>" for x in long)
    for tag in ("nav", "aside", "footer", "menu", "header"):
        assert text(f"<body><{tag}><a>Home</a><article>{body}</article></body>").split("\n") == long
        assert text(f"<body><{tag}><a>Home</a><{tag}><main>{body}</main></body>").split("\n") == long
        assert text(f"<body><{tag}><div><p>{long[0]}</p></div></body>") == long[0]  # otherwise the page would be empty
        assert text(f"<body><{tag}>Home</{tag}></body>") == ""
    assert text(f"<aside><article>{long[0]}</article></aside><article>{body}</article>").split("\n") == long
    for name in ("share", "related", "social", "side", "promotion"):
        assert text(f'<article><p>{long[0]}</p><section class="{name}">{body}</section></article>').split("\n") == [long[0], *long]
        assert text(f'<main><article>{body}</article><div class="{name}">{body * 2}</div></main>').split("\n") == long
        assert text(f'<article>{body}<div class="{name}"><p>{long[0]}</p></div></article>').split("\n") == long
    assert text(f"<p>{long[0]}</p><textarea>hidden</textarea><label>pick <select><option>a</select></label><p>{long[1]}</p>").split("\n") == long[:2]


def test_html_frames(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages, carry=("url", "text", "html"))
    assert got.columns == ["page_id", "url", "text", "html", "text_"]
    assert sorted(str(r.text_) for r in got.collect()) == ["", "", "a", "a"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_regions_without_one_article():
    long = [f"Sentence {k} of the text, which goes on for quite a while to be dense." for k in range(8)]
    items, paragraphs = "".join(f"<li>{x}" for x in long[:5]), "".join(f"<p>{x}</p>" for x in long[:5])
    page = f"<body><div id=content><p>{long[5]}</p><ul>{items}</ul><p>{long[6]}</p></div></body>"
    assert html_text.main_text(page).split("\n") == [long[5], *long[:5], long[6]]
    two = [f"<{{0}}>{paragraphs}</{{0}}>", f"<{{0}}><p>{long[5]}</p><p>{long[6]}</p></{{0}}>", "<{0}><p>Short.</p></{0}>"]
    for tag, outer in (("section", "div"), ("article", "main"), ("article", "body"), ("section", "article")):
        for some in (two, two[1:], [two[0], two[2]]):
            got = html_text.main_text(f"<nav>Home</nav><{outer}>{''.join(some).format(tag)}</{outer}><footer>F</footer>").split("\n")
            assert got == [x for k, t in ((two[0], long[:5]), (two[1], long[5:7]), (two[2], ["Short."])) if k in some for x in t]
    assert html_text.main_text(f"<div><p>Short.</p><table><tr><td><div>{long[0]}</div><td>x</table></div>").split("\n") == ["Short.", long[0], "x"]


def test_html_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries_corpus.op5_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip() for b in re.split("</?(?:h1|p)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_neighbours_of_doubles_are_told_apart(spark):
    rows = [(k, [1 + k * 1e-9, 0.5]) for k in range(60)]
    for kind, v in (("double", rows), ("decimal(20,12)", [(k, [Decimal(str(round(x, 12))) for x in e]) for k, e in rows])):
        got = nearest.neighbours(spark.createDataFrame(v, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") == 0, k=3).collect()
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [59, 58, 57]
        assert all(r.score == rows[0][1][0] * rows[r.vec_id][1][0] + 0.25 for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16)).astype("float32")
    v[5], v[6], v[7] = v[40], v[40], v[40]  # equal vectors: ties go to the smaller id
    rows = [(k, v[k].tolist(), 0) for k in range(3000)] + [(None, v[0].tolist(), 0), (9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [1.0, None] * 8, 0), (9080, [1.0] * 3, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest.neighbours(frame, F.col("vec_id") % 20 == 0, k=10, share=0.8).toPandas()
    hit, ids = 0, np.arange(3000)
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        exact = (v.astype(float) * v[q].astype(float)).sum(1)
        exact[q] = -np.inf
        best = np.lexsort((ids, -exact))[:10]
        hit += len(set(best) & set(part.vec_id))
        assert len(part) == 10 and (part.score.to_numpy() == exact[part.vec_id]).all()
        assert list(part.vec_id) == [ids[k] for k in sorted(part.vec_id, key=lambda k: (-exact[k], k))]
    assert got.query_id.nunique() == 150 and hit / 1500 >= 0.9
    few = frame.where("vec_id < 6")
    assert nearest.neighbours(few, F.col("vec_id") % 20 == 0, k=20).count() == 5
    assert nearest.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_neighbours_query_recall(spark, folder):
    """The registered query against all inner products; scores are exact and in order."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float32).astype(float)
    got = queries_corpus.op3_nearest_neighbours(spark, folder).toPandas()
    of, hit = {int(i): k for k, i in enumerate(ids)}, 0
    for q, part in got.groupby("query_id"):
        part, exact = part.sort_values("rank"), v @ v[of[q]]
        exact[of[q]] = -np.inf
        assert np.allclose(part.score, exact[[of[i] for i in part.vec_id]], atol=1e-12)
        assert list(part["rank"]) == list(range(1, 21)) and (np.diff(part.score) <= 0).all()
        hit += len(set(ids[np.lexsort((ids, -exact))[:20]]) & set(part.vec_id))
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hit >= 0.92 * len(got)


def test_neighbours_with_one_sided_blocks_and_repeated_rows(spark):
    """Cells with vectors and no visitors, the reverse, and rows that occur thrice."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 8)).astype("float32")
    v[:700] = v[0]
    rows = [(k, v[k].tolist(), "x", 1) for k in range(1500) for _ in range(3 if k % 100 == 0 else 1)]
    frame = spark.createDataFrame(rows, "key long, embedding array<float>, code string, cell int")
    for share in (0.1, 0.75):
        got = nearest.neighbours(frame, F.col("key") % 50 == 0, k=20, id_col="key", share=share, block=64, visitors=7).toPandas()
        assert got.groupby("query_id").size().tolist() == [20] * 30
        assert (got.query_id != got.vec_id).all() and got.groupby(["query_id", "vec_id"]).size().max() <= 3
        for q, part in got.groupby("query_id"):
            part = part.sort_values("rank")
            assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))


def test_neighbours_among_thousands_of_equal_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 16)).astype("float32")
    ids = rng.permutation(6000)
    same = rng.choice(6000, 2500, replace=False)
    v[same] = v[same[0]]
    frame = spark.createDataFrame([(int(ids[k]), v[k].tolist()) for k in range(6000)], "vec_id long, embedding array<float>").repartition(3)
    got = nearest.neighbours(frame, F.col("vec_id") % 7 == 0, k=20, block=2048).toPandas()
    copies, of = set(ids[same].tolist()), {int(i): k for k, i in enumerate(ids)}
    exact = v.astype(float) @ v[same[0]].astype(float)
    hit = asked = 0
    for q, part in got.groupby("query_id"):
        found = part.sort_values("rank").vec_id.tolist()
        assert q not in found and len(set(found)) == 20
        order = np.lexsort((ids, -(v.astype(float) @ v[of[q]].astype(float))))
        best = [int(ids[k]) for k in order if ids[k] != q][:20]
        if q in copies:
            first = [int(ids[k]) for k in np.lexsort((ids, -exact)) if ids[k] != q][:20]
            asked += 1
            hit += len(set(found) & set(first)) / 20
        mine = [i for i in found if i in copies]
        assert mine == sorted(copies - {q})[: len(mine)]
        if not mine:
            assert len(set(found) & set(best)) >= 10
    assert asked > 300 and hit / asked >= 0.99


def test_equal_vectors_of_a_block_keep_their_smallest_ids():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 8)).astype("float32")
    v[:600] = v[0]
    ids = rng.permutation(900)
    ids[600:650] = ids[600]  # rows of one id
    v[600:625] = v[600]
    index = nearest.fit(v, 1)
    _, codes = index.assign(v)
    asked = np.r_[0:3, 600:602, 700:703]
    exact = v.astype(float) @ v[asked].T.astype(float)
    for n, (found, scores) in enumerate(index.search(0, v[asked], ids[asked], ids, codes, v, 20, 280)):  # 277 distinct vectors
        rows = [k for k in np.lexsort((ids, -np.round(exact[:, n], 9))) if ids[k] != ids[asked[n]]][:20]
        assert found.tolist() == ids[rows].tolist() and np.allclose(scores, exact[rows, n])


def test_pipeline_stages_against_their_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, SF)
    assert one.columns == docs.columns
    verdict = quality.assess(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in verdict.where("kept").collect()}
    two = corpus_pipeline.toxicity_filter(spark, one, SF)
    machine = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), where=~queries_corpus.held_out(F.col("doc_id")))
    bad = {r.doc_id for r in toxicity.assess(docs, machine).where("predicted = 1").collect()}
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect()} - bad
    from test_ngram_join import brute

    three = corpus_pipeline.near_copies(spark, two, SF)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    groups = {}
    for i, n, c, _ in brute(rows, 5, 80):
        groups.setdefault(c if n else ("alone", i), set()).add(i)
    kept = {r.doc_id for r in three.collect()}
    assert len(kept) == len(groups) and all(len(kept & g) == 1 for g in groups.values())
    four = corpus_pipeline.secret_masks(spark, three, SF)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == kept
    assert secrets.scan(four).select(F.explode("spans").alias("s")).where("s.kind = 'hex'").count() == 0
    five = corpus_pipeline.packing(spark, four, SF)
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, SF).select(order).collect()) == sorted(five.select(order).collect())
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == kept
    some = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "token: abcdef12 é " * 90_000, "en", "s", 0)]
    odd = docs.limit(0).unionByName(spark.createDataFrame(some, docs.schema)).withColumn("kept", F.lit(1)).withColumn("__row_key", F.lit("k"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd,) if name == "n-gram join" else (odd, odd.limit(0)):  # its empty table is in its own tests
            left = stage(spark, rows, SF)
            assert name == "packing" or left.columns == odd.columns
            assert left.count() >= (0 if name == "quality rules" or not rows.count() else 1)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram join", "secret scans", "packing"]
