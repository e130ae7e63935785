import hashlib
import random
import sys

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from schemaloom.llm import byte_bpe as B  # noqa: E402

RANKS = B.read_ranks(P.path("byte_bpe_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = B.Codec(RANKS, P.PATTERN)


def test_perfect_hash_is_minimal_and_perfect():
    h = CODEC.tokens
    assert sorted(map(h, RANKS)) == list(range(len(RANKS)))
    assert h(b"no such token at all") == -1
    assert B.PerfectHash([])(b"x") == -1 and B.PerfectHash([b"x"])(b"x") == 0


def test_every_code_point_like_tiktoken():
    enc = CODEC.encoder()
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    bad = []
    for k in range(0, len(points), 64):
        text = "a" + "1".join(points[k : k + 64]) + "  b"
        if enc(text).tolist() != REAL.encode_ordinary(text):
            bad.append(k)
    assert not bad


def test_random_and_long_texts_like_tiktoken():
    enc, rng = CODEC.encoder(), random.Random(1)
    alphabet = "abcdefghij'sté ß漢🙂\n\t 0123.,!<|endoftext|>  \x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["", " ", "a" * 20000, "ab" * 9000, " " * 5000 + "x", "!?" * 3000]
    for t in texts:
        ids = enc(t)
        assert ids.tolist() == REAL.encode_ordinary(t)
        assert CODEC.decode(ids) == t.encode()


def test_query_digests(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (-3, "a b"), (-3, "a b")], docs.schema))
    got = sorted((tuple(r) for r in B.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = REAL.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_table(spark):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "")], "doc_id long, text string")
    ids = B.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert back == {1: "Hello wörld".encode(), 2: b"", 3: b""}
    assert B.encode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
