import hashlib
import random

import numpy as np
import pytest

from schemaloom.llm import substring_dedup as S
from schemaloom.llm.batch_words import batch_words


def slow(rows, width=13):
    firsts = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                firsts[key] = min(firsts.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and firsts[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    from pyspark.sql import functions as F

    got = S.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_batch_words_tell_words_apart():
    texts = [b"a b  c\n", None, b"", b"\xc3\xa9 a", b"   ", b"b"]
    half, ends = batch_words(texts)
    h = half(1)
    assert ends.tolist() == [3, 4, 5, 8, 9, 11] and len(h) == 12
    assert h[0] == h[7] and h[1] == h[10] and len({*h[[0, 1, 2, 6]].tolist()}) == 4


def test_equal_windows_have_equal_symbols():
    rng = random.Random(4)
    text = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(300)] + ["x"] * 40
    cut = text[37:120]
    h = batch_words([" ".join(text).encode(), " ".join(cut).encode()])[0](0)
    a, b = h[:340], h[341:424]
    wa, wb = S.window_hashes(a, 13), S.window_hashes(b, 13)
    assert (wa[37 : 37 + len(wb)] == wb).all()
    assert (S.window_symbols(a, wa)[37 : 37 + len(wb)] == S.window_symbols(b, wb)).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tables(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 0 if seed == 1 else 1 << 30)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30 if seed == 1 else 2 if seed == 2 else 400)] + ["é", "漢字"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((rng.randint(0, 90), rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, " ".join(passages[0])), (500, None), (501, ""), (502, "x " * 300), (503, "x " * 20), (504, " ".join(["p q"] * 3000))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_table_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert S.dedup(docs.limit(0)).count() == 0


def test_words_that_differ_by_a_few_bits_stay_apart(spark):
    """Thue-Morse words and their complements, which polynomial hashes modulo a power of two can't tell apart."""
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    rows = [(k, " ".join([w] + [f"w{j}" for j in range(12)])) for k, w in enumerate((x, y, x))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_names_don_t_depend_on_what_stands_around():
    words = [b"a", b"ab", b"ba", b"aab", b"x" * 63, b"x" * 64, b"x" * 65, b"y" * 300, b"x" * 64 + b"y", "é".encode(), b"\x1c"]
    rng = random.Random(1)
    alone = {w: tuple(int(batch_words([w])[0](k)[0]) for k in (0, 1)) for w in words}
    assert len(set(alone.values())) == len(words) and len({v for x in alone.values() for v in x}) == 2 * len(words)
    for _ in range(20):
        texts = [[rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(5)]
        half, ends = batch_words([b" \t".join(t) + rng.choice([b"", b"\n"]) for t in texts])
        got = [tuple(map(int, x)) for x in zip(np.delete(half(0), ends), np.delete(half(1), ends))]
        assert got == [alone[w] for t in texts for w in t]


def test_clashing_columns_pass_through(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a " * 20), (2, "a " * 20), (2, "a " * 20)], "doc_id long, text string").withColumn("ws", F.lit("x")).withColumn("n_words", F.lit(-1))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in S.dedup(docs).collect()) == [(1, 20, 0), (2, 20, 20), (2, 20, 20)]
