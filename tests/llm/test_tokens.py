import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from quorum.llm.byte_bpe import decode, encode, reference_pieces
from quorum.llm.packing import Packer, pack, powers
from quorum.llm.token_counts import count_tokens
from quorum.llm.tokens import ByteEncoder, PieceCounter

PATTERN = public_tokenizers.PATTERN
JSON, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n b", "\n  b", "a\n\n  b \n", "don't I'll '", "x" * 300, "é\u0301 ñ\u00a0\u2003 q", "<|endoftext|> end <|endoftext|>", "1234 567", "日本語 テキスト", "🙂 🙂", "\x1c \x1d", "▁ a", "a\tb", "<s> </s> <unk>"]
DOCS = "doc_id long, text string, ids string, part long"


def texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "word", "Word,", "it's", "123", "é", "###", "\t"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(150)]


def ours(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoders_equal_their_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    model, theirs = Tokenizer.from_file(JSON), library()
    pieces, count = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCounter(PIECES)
    a, b = ByteEncoder(JSON, PATTERN, special=True), ByteEncoder(RANKS, PATTERN)
    assert count.cuts
    for t in texts() * 2:
        assert a.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)
        assert b.ids(t).tolist() == theirs.encode_ordinary(t), repr(t)
        assert count.count(t) == len(pieces.encode(t)), repr(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sré1#\u00a0"), max_size=120), st.integers(4, 20))
def test_chunks_meet_at_true_boundaries(text, chunk):
    theirs = library()
    pieces = reference_pieces(text, PATTERN, chunk, 8)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in theirs.encode_ordinary(p)] == theirs.encode_ordinary(text)


def test_encode_and_decode_with_chunks(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (3, "same"), (3, "same"), (900, None), (901, "z" * 500 + " end"), (902, "a b c " * 400)]
    got = decode(encode(ours(spark, rows), RANKS, PATTERN, chunk=64, overlap=16), RANKS).select("doc_id", "ids", "decoded").collect()
    theirs = library()
    want = sorted((str(i), tuple(theirs.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert encode(ours(spark, []), RANKS, PATTERN).count() == 0


def test_counts_come_from_the_cache(spark, tmp_path):
    import sentencepiece

    pieces, cache = sentencepiece.SentencePieceProcessor(model_file=PIECES), str(tmp_path / "counts")
    rows = list(enumerate(texts())) + [(None, "x"), (1, None), (1, "x"), (1, "x")]
    for _ in range(2):
        got = count_tokens(ours(spark, rows), PIECES, cache, limit=20).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n := len(pieces.encode(t or "")), n > 20) for i, t in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})  # each distinct text once, although counted twice
    count_tokens(ours(spark, [(7, "something new")]), PIECES, cache)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert spark.read.parquet(cache).select("digest").distinct().count() == len({t or "" for _, t in rows}) + 1
    assert count_tokens(ours(spark, []), PIECES, cache).count() == 0


def test_other_library_by_suffix(spark):
    from tokenizers import Tokenizer

    got = count_tokens(ours(spark, [(1, "Some words <|endoftext|>")]), JSON).collect()
    assert got[0].n_tokens == len(Tokenizer.from_file(JSON).encode("Some words <|endoftext|>", add_special_tokens=False).ids)


def sequences(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    return by


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON)
    rows = [*enumerate(texts()), (None, "nobody"), (500, None), (501, "many words here " * 900)]
    docs = ours(spark, rows).repartition(5)
    got = [r.asDict() for r in pack(docs, JSON, PATTERN, window=64, open_windows=3, fan_in=2).collect()]
    want = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for i, t in rows}
    for i, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids
        assert all(r["doc_tokens"] == len(ids) // 4 and len(r["ids"]) == 4 * r["length"] for r in own)
    sizes = sequences(got).values()
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes)  # no padding at all
    assert pack(ours(spark, []), JSON, PATTERN).count() == 0


def test_query_digests(spark):
    from quorum.llm.queries_tokens import op4_byte_bpe, op10_packing

    path = "/root/testdata/sf0.001"
    docs, theirs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}, library()
    for r in op4_byte_bpe(spark, path).collect():
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    encoder = ByteEncoder(JSON, PATTERN, special=True)
    for r in op10_packing(spark, path).collect():
        ids = encoder.encode(docs[r.doc_id]) + bytes(4)
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])


def test_token_counts_of_the_query_equal_the_library(spark):
    import sentencepiece

    from quorum.llm.queries_tokens import op9_token_counts

    path, pieces = "/root/testdata/sf0.001", sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op9_token_counts(spark, path).collect())
    assert got == sorted((i, len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in docs)


def test_packed_pieces_of_the_query_equal_the_library(spark):
    from tokenizers import Tokenizer

    from quorum.llm.queries_tokens import op10_packing

    path, model = "/root/testdata/sf0.001", Tokenizer.from_file(JSON)
    ids = {r.doc_id: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = [r.asDict() for r in op10_packing(spark, path).collect()]
    assert all((r["doc_tokens"], r["ids_crc32"]) == (len(x := ids[r["doc_id"]]), zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())) for r in rows)
    for i, own in ids.items():  # the pieces of a document follow each other without a gap
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(own)
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences(rows).values())


def test_names_of_any_kind_very_long_and_repeated_rows(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(1, "a b", b"x", 0), (1, "a b", b"x", 0), (2, "wort und text " * 60_000, None, 1), (3, None, b"", 2), (4, "q" * 50_000, b"", 2)]
    frame = spark.createDataFrame(rows, "`d.id` long, `the.text` string, decoded binary, `row key` long")
    at, texts_of, theirs = dict(id_col="d.id", text_col="the.text"), {r[0]: r[1] or "" for r in rows}, library()
    coded = encode(frame, RANKS, PATTERN, **at).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in coded) == sorted((r[0], len(theirs.encode_ordinary(r[1] or ""))) for r in rows)
    count = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(frame, PIECES, **at).collect()) == sorted((r[0], len(count.encode(r[1] or ""))) for r in rows)
    model, packed = Tokenizer.from_file(JSON), [r.asDict() for r in pack(frame, JSON, PATTERN, **at).collect()]
    sequences(packed)
    for i, t in texts_of.items():
        copies = sum(r[0] == i for r in rows)  # each repeated row is packed for itself
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == copies * (len(model.encode(t, add_special_tokens=False).ids) + 1)


def test_decoding_keeps_all_columns(spark):
    frame = spark.createDataFrame([([0, 1], "mine", 3), (None, None, None)], "`an.id list` array<int>, decoded string, `x.y` int")
    got = decode(frame, RANKS, ids_col="an.id list")
    assert got.columns == ["an.id list", "decoded", "x.y", "decoded_"]
    assert [(r["decoded"], r["x.y"], r["decoded_"]) for r in got.collect()] == [("mine", 3, library().decode_bytes([0, 1])), (None, None, None)]


@given(st.lists(st.integers(1, 200), max_size=60), st.integers(1, 5))
def test_packer_keeps_order_and_bounds(sizes, limit):
    packer, done = Packer(32, limit), []
    for d, n in enumerate(sizes):
        done += packer.add(d, 0, np.arange(n, dtype="<u4").tobytes(), n)
        assert len(packer.open) <= limit
    assert all(sum(len(p[2]) for p in w) == 128 for w in done)
    for w in packer.open:
        done += list(powers(w))
    ids = {d: sorted((p[1], bytes(p[2])) for w in done for p in w if p[0] == d) for d in range(len(sizes))}
    assert all(b"".join(x for _, x in ids[d]) == np.arange(n, dtype="<u4").tobytes() for d, n in enumerate(sizes))
