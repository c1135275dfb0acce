import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from quorum.llm.queries_tokens import op13_word_bpe
from quorum.llm.tree_bpe import UNITS, WordEncoder, decode, encode, parts

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", " \n\t ", "a", " Ab ", "don't I'LL '", "x" * 300, "é́ É ñ", "<|endoftext|> end<|endoftext|>x <|startoftext|>", "1234 567", "日本語 テキスト", "🙂🙂 !!??", "\x1c \x1d\x85a b c", "J̌ İI K", "a ́b", "</w> a</w>", "ΑΣ Σ", "<|endof text|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    model.no_truncation()
    model.no_padding()
    return model


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(WORDS)


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def texts():
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "word", "Word,", "it's", "123", "É", "é", "###", "<|endoftext|>", " ", "J̌"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(150)]


def test_units_equal_the_library(library, encoder):
    assert encoder.cuts
    for _ in range(2):  # the second time from memory
        for t, got in zip(texts(), encoder.encode(texts()), strict=True):
            assert ids(got) == library.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinrst"), min_size=1, max_size=200), st.integers(1, 30))
def test_trees_equal_whole_words(library, encoder, word, leaf):
    assert encoder.tree(word, leaf) == library.encode(word, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["a", "ha", "the", "=", "-=", "lo"]), st.integers(1, 400), st.integers(1, 40))
def test_trees_of_periodic_words(library, encoder, unit, times, leaf):
    assert encoder.tree(unit * times, leaf) == library.encode(unit * times, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "ab", "Ab1", "é", "x" * 30, "!!", "<|endoftext|>", "'s", "日本"]), max_size=40), st.integers(1, 12))
def test_parts_equal_the_library(library, encoder, bits, leaf):
    text, got = "".join(bits), {}
    for part, k, n, kind, piece in parts(encoder, text, 20, leaf):
        if kind == UNITS:
            got[part, k] = ids(encoder.encode([piece])[0])
        else:
            got.setdefault((part, 0), [])
            got[part, k] = [i for w in piece.split(" ") for i in encoder.piece(w, k + 1 == n)]
        assert k < n
    seen = []
    for part in sorted({p for p, _ in got}):
        level = [got[x] for x in sorted(got) if x[0] == part]
        while len(level) > 1:
            level = [encoder.join(level[k], level[k + 1], k + 2 >= len(level)) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        seen += level[0]
    assert seen == library.encode(text, add_special_tokens=False).ids


def test_tables_equal_the_library(spark, library):
    long = ["z" * 1001, "hello" * 77 + " End" * 50, " " * 90, "".join(random.Random(3).choice("aeinrst") for _ in range(3000)), "=" * 129 + "<|endoftext|>" + "Wör" * 60 + " a b c"]
    rows = [*enumerate(texts()), (None, "a b"), (3, "same"), (3, "same"), (800, None), *enumerate(long, 900), (900, long[0])]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "`id.of` long, `text.of` string, ids string, part long, decoded string")
    coded = encode(docs, WORDS, "id.of", "text.of", chunk=64, leaf=16)
    got = decode(decode(coded, WORDS), WORDS).collect()
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False)
        text = library.decode(e.ids, skip_special_tokens=False)
        want.append((str(i), e.ids, text, text))
    assert sorted((str(r.doc_id), ids(r.ids), r.decoded, r.decoded_) for r in got) == sorted(want)
    assert encode(docs.limit(0), WORDS, "id.of", "text.of").count() == 0


def test_query_digests(spark, library):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op13_word_bpe(spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        e = library.encode(docs[r.doc_id] or "", add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(np.array(e.ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
