"""License scan, quality rules and toxicity against brute force and on odd rows."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import license_scan as L, quality_rules as Q, toxicity as X

ODD = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "cc by"), (5, "CC-BY cc by, cc  by"), (6, "é" * 5000 + " all RIGHTS\nreserved"), (7, "word " * 40000)]


def rows(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("kept", F.lit(7))


def slow_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    hits = [(k, label) for p, label in L.BASE for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_counts(spark, sf):
    docs = rows(spark).select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    got = sorted((str(r.doc_id), *r[1:6]) for r in L.scan(docs).collect())
    assert sorted(got, key=str) == sorted(((str(r.doc_id), *slow_base(r.text)) for r in docs.collect()), key=str)
    assert L.scan(rows(spark)).count() == len(ODD) and L.scan(docs.limit(0)).count() == 0


def test_edits_within_the_bound_are_found():
    rng, scan = random.Random(2), L.Scanner()
    for phrase, label, k, core in L.NOTICES:
        assert len(L.pieces(phrase.encode(), k)) == k + 1
        for _ in range(30):
            s = list(phrase)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(1, len(s) - 1)
                t = s[:at] + [rng.choice("abcdexyz")] + s[at + (rng.random() < 0.5) :]
                s = t if not core or core in "".join(t).split() else s
            labels, spans = scan(f"text before {''.join(s)} and after".encode())[5], scan(f"text before {''.join(s)} and after".encode())[7]
            assert label in labels.split(",")
            assert any(x["first_word"] in (1, 2) and x["edits"] <= k for x in spans if x["label"] == label)
    assert scan(b"nothing of this kind stands here, by and large")[5] == ""


def slow_labels(text):
    """Labels of all notices that some run of whole words is within the edits of, by plain edit distance."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = {label for p, label in L.BASE if f" {p} " in f" {' '.join(words)} "}
    for phrase, label, k, core in L.NOTICES:
        for a in range(len(words)):
            row, run = list(range(len(phrase) + 1)), ""
            for e in range(a, len(words)):
                for c in (" " if run else "") + words[e]:
                    new = [row[0] + 1]
                    for j, x in enumerate(phrase):
                        new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
                    row = new
                run += (" " if run else "") + words[e]
                if row[-1] <= k and (not core or core in words[a : e + 1]):
                    found.add(label)
                if min(row) > k:
                    break
    return ",".join(sorted(found))


def test_labels_equal_plain_edit_distance():
    rng, scan = random.Random(9), L.Scanner()
    filler = "the license of a unit its site mpl public rights all free use in source and general domain by cc mit".split()
    for _ in range(150):
        w = [rng.choice(filler) for _ in range(12)]
        phrase = list(rng.choice(L.NOTICES)[0])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(phrase))
            phrase[at] = rng.choice(["", "x", phrase[at] + "e", " "])
        text = " ".join(w[:6] + ["".join(phrase)] + w[6:])
        assert scan(text.encode())[5] == slow_labels(text), text
    for text in ("the site license", "the unit license", "the mpl license", "the its license", "the kit license"):
        assert scan(text.encode())[5] == ""
    assert scan(b"under the mit lisence")[5] == "mit" and scan(b"of all rigths reserved")[5] == "reserved"


def test_scan_time_grows_with_the_text():
    scan = L.Scanner()
    for piece in (b"cc by ", b"the mit license ", b"public license "):
        began = time.time()
        assert scan(piece * 60_000)[0] >= 120_000
        assert time.time() - began < 20, piece


def slow_stats(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    many = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else set(windows)
    hit = {k + j for k, x in enumerate(windows) if x in many for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, sf):
    texts = [t for _, t in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["a b c d e f g h " * 3, "x\ny\nx\n x"]
    stats = Q.Statistics()
    for t in texts:
        assert stats(None if t is None else t.encode())[0] == slow_stats(t)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    m = Q.train(x, y, (-1, 0, 0))
    assert ((m.score(x) > 0) == (y > 0)).mean() > 0.97
    line = np.repeat(rng.random((1, 3)), 50, 0)
    line[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(m.score(line)) <= 1e-12).all()
    assert np.isfinite(Q.train(x[:0], y[:0], (-1, 0, 0)).score(x)).all()


def test_quality_on_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([got[i].kept == bool(q) for i, q in want.items() if not got[i].base_failed]) > 0.9
    assert Q.score(rows(spark), model).count() == len(ODD)
    assert Q.score(docs, Q.fit(docs, labels.limit(0))).count() == docs.count()


@pytest.mark.filterwarnings("ignore")
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.fit(docs, labels.where("doc_id % 4 <> 0"))
    assert model.cuts == sorted(model.cuts)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [(got[r.doc_id].toxic, r.toxic) for r in labels.where("doc_id % 4 = 0").collect()]
    assert np.mean([bool(t) == a for a, t in held]) > 0.88
    assert np.mean([a for a, t in held if not t]) < 0.03
    odd = X.score(rows(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.expected_severity <= 3 for r in odd)
    assert not any(r.toxic for r in X.score(rows(spark), X.fit(docs, labels.limit(0))).collect())
