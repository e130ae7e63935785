"""Runs of words counted through compressed records, and what is made of them."""

import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from schemaloom.operators import runs, terms as R
from schemaloom.plans import queries as Q

ODD = ["A b. C d!  e? f\n\nG h\n \t\n i.\x0bj k.l m n.  o", "Kelvin Kelvin İstanbul ΣΣ x x x x x x x", None, "", " . ", "the end.\nthe end.\n\n\nthe end", "a.b.c. a.b.c a.b.c a!\x1cb", "x\ty z\r\nq\r\n\r\nw? \n v"] * 3


def shuffled(spark, make) -> int:
    """Bytes that the stages of make().collect() sent and spilled."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() + x.diskBytesSpilled() for x in list(sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())))}
    before = stages()
    make().collect()
    return sum(n for k, n in stages().items() if k not in before)


def odd_docs(spark, sf):
    made = spark.createDataFrame([(-k, x) for k, x in enumerate(ODD, 1)], "doc_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").union(made)


@pytest.fixture(scope="module")
def rare(spark):
    """300 texts of 400 words of which most are seldom beside the same words."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(3000)]
    rows = [(d, ". ".join(" ".join(rng.choices(words, k=20)) for _ in range(20))) for d in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)


def test_odd_texts_count_as_sentences_have_them(spark, sf):
    docs = odd_docs(spark, sf)
    for least in (1, 3):
        slow = R.frequencies(R.ngrams(R.sentences(docs)), least)
        assert sorted(map(tuple, R.ngram_frequencies(docs, least=least).collect())) == sorted(map(tuple, slow.collect()))


@pytest.mark.parametrize("longest,tokens,words", [(4, 50, 10**6), (4, 10**6, 7), (3, 5, 5), (2, 3, 3), (1, 1, 1), (5, 64, 64)])
def test_chunks_end_anywhere(monkeypatch, longest, tokens, words):
    monkeypatch.setattr(runs, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(runs, "CHUNK_WORDS", words)
    monkeypatch.setattr(runs, "LONG_CHARS", 200)
    monkeypatch.setattr(runs, "MERGE_RECORDS", 20)
    rng = random.Random(longest)
    sentences = [[[rng.choice("abcde") for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(0, 30))] for _ in range(20)]
    texts = [". ".join(" ".join(s) for s in text) for text in sentences]
    want = Counter(tuple(s[i : i + n]) for text in sentences for s in text for n in range(1, longest + 1) for i in range(len(s) - n + 1))
    classes = ["a", "b c", "a b a"]
    follow = Counter((c, *s[i + k : i + k + n]) for text in sentences for s in text for c in classes for k in [len(c.split())] for i in range(len(s)) if s[i : i + k] == c.split() for n in range(1, longest + 1) if i + k + n <= len(s))
    for (ahead, columns), width, least_tokens, expected in ((runs.ngram_columns(longest), longest, 1, want), (runs.after_columns(classes, longest), longest + 1, 2, follow)):
        sent = pa.Table.from_batches(runs._sender(ahead, columns, 3)(iter([pa.record_batch([texts[:7]], ["text"]), pa.record_batch([texts[7:]], ["text"])])))
        got = {}
        for bucket in set(sent["bucket"].to_pylist()):
            for r in runs._receiver(width, 2)(sent.filter(pa.compute.equal(sent["bucket"], bucket))).to_pylist():
                key = (r["head"], *r["tail"].split())
                assert key not in got and len(key) == r["n_tokens"]
                got[key] = r["freq"]
        assert {k: n for k, n in got.items() if len(k) >= least_tokens} == {k: n for k, n in expected.items() if n >= 2}


def test_frequencies_send_less_than_the_texts_twice(spark, rare):
    chars = rare.agg(F.sum(F.length("text"))).first()[0]
    assert shuffled(spark, lambda: R.ngram_frequencies(rare)) < 2 * chars


def test_more_buckets_send_little_more(spark, rare, monkeypatch):
    chars = rare.agg(F.sum(F.length("text"))).first()[0]
    sent, found = [], []
    for buckets in (2, 60):
        monkeypatch.setattr(runs, "BUCKET_CHARS", chars // buckets)
        sent.append(shuffled(spark, lambda: found.append(sorted(map(tuple, R.ngram_frequencies(rare).collect()))) or rare.limit(0)))
    assert found[0] == found[1] and sent[1] < 1.25 * sent[0], sent


@pytest.mark.parametrize("common", [[], ["b"], ["e", "zz", "a", "c"], list("abcde")])
def test_common_words_change_no_count(monkeypatch, common):
    monkeypatch.setattr(runs, "MERGE_RECORDS", 20)
    monkeypatch.setattr(runs, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(runs, "CHUNK_WORDS", 4)
    rng = random.Random(5)
    sentences = [[rng.choice("abcde") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    want = Counter(tuple(s[i : i + n]) for s in sentences for n in range(1, 5) for i in range(len(s) - n + 1))
    sent = pa.Table.from_batches(runs._sender(*runs.ngram_columns(4), 5, common)(iter([pa.record_batch([[" ".join(s) for s in sentences]], ["text"])])))
    got = Counter()
    for bucket in set(sent["bucket"].to_pylist()):
        for r in runs._receiver(4, 1, common)(sent.filter(pa.compute.equal(sent["bucket"], bucket))).to_pylist():
            got[(r["head"], *r["tail"].split())] += r["freq"]
    assert got == want


@pytest.fixture(scope="module")
def terms(spark, sf):
    path = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100")
    rows = R.ngram_frequencies(path, least=2).collect()
    return spark.createDataFrame(rows, "term string, n_tokens int, freq long").coalesce(2)


def test_c_value_by_brute_force(spark, terms):
    freq = {r.term: r.freq for r in terms.collect()}
    inside = {(" ".join(t[i : i + n]), c) for c in freq for t in [c.split()] for n in range(1, len(t)) for i in range(len(t) - n + 1)}
    around = {}
    for t, c in inside:
        around.setdefault(t, []).append(freq[c])
    want = {t: math.log2(len(t.split()) + 1) * (n - (sum(around[t]) / len(around[t]) if t in around else 0)) for t, n in freq.items()}
    assert {r.term: r.score for r in R.c_value(terms).collect()} == pytest.approx(want)
    assert sorted(map(tuple, R.nesting(terms, closed=True).collect())) == sorted(map(tuple, R.nesting(terms).collect())) == sorted(inside)
    some = terms.where("freq % 2 = 0")  # not closed: what stands inside a term need not be one
    kept = {t for t, n in freq.items() if n % 2 == 0}
    assert sorted(map(tuple, R.nesting(some).collect())) == sorted((t, c) for t, c in inside if t in kept and c in kept)


def test_c_value_sends_no_pairs_of_terms(spark, terms):
    chars = terms.agg(F.sum(F.length("term"))).first()[0]
    assert shuffled(spark, lambda: R.c_value(terms)) < 4 * chars


@pytest.mark.parametrize("name", ["term_cvalue_top", "jn_nesting", "agg_attributes"])
def test_term_queries_send_little(spark, sf, name):
    chars = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert shuffled(spark, lambda: Q.QUERIES[name](spark, sf)) < 3 * chars


def test_attributes_equal_those_of_all_candidates(spark, sf):
    docs = odd_docs(spark, sf)
    f = R.ngram_frequencies(docs, least=2)
    classes = spark.createDataFrame([(t,) for t in ("the", "of the", "x", "x x", "that", "k", "no such term")], "term string")
    slow = R.attributes(R.ngrams(R.sentences(docs)), classes, 2, 10, guards=f)
    fast = R.ngram_attributes(docs, classes, least=2, guards=f)
    found = sorted(map(tuple, fast.collect()))
    assert found == sorted(map(tuple, slow.select(fast.columns).collect())) and len({x[0] for x in found}) >= 4
    assert R.ngram_attributes(docs, classes.limit(0)).count() == 0
