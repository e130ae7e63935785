"""The pipeline's stages against brute force, on documents with odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as L
from schemaloom.llm import quality_rules as Q, toxicity as X
from schemaloom.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, whole long"


def corpus(rng):
    """Documents with copies, near copies, shared passages, and rows that are null, empty, long or repeated."""
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(600)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = prose(60)
    texts = []
    for _ in range(25):
        w = prose(rng.randint(40, 160))
        texts.append(w)
        if rng.random() < 0.6:
            x = list(w)
            x[rng.randrange(len(x))] = "changed"
            texts.append(x)
        if rng.random() < 0.3:
            texts += [w, [v.upper() for v in w]]
        if rng.random() < 0.4:
            texts.append(prose(30) + passage + prose(30))
    rows = [(i, " ".join(t), "en", rng.choice("ab"), 0, "k", 1) for i, t in enumerate(texts)]
    rows += [(1, None, "en", "a", None, None, None), (2, "", "en", "a", 0, None, None), (500, " \n", None, None, 0, None, None)]
    rows += [rows[4], rows[4], (4, " ".join(prose(50)), "xx", "b", 0, "other", 2), (None, rows[3][1], "en", "a", 0, None, None)]
    rows += [(None, " ".join(prose(70)), "en", "b", 0, None, None)] * 2 + [(600, " ".join(prose(40) * 400), "en", "a", 0, None, None)]
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def slow_near_dedup(rows):
    """Of each group one row stays: the smallest id, null ids last; any of several with that id, equal ones once."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    out = []
    for g in groups.values():
        first = min((r[0] is None, r[0] or 0) for r in g)
        out.append({r for r in g if (r[0] is None, r[0] or 0) == first})
    return out


def slow_repeats(rows, width=13):
    firsts = {}
    for r in rows:
        w = (r[1] or "").split()
        for k in range(len(w) - width + 1 if r[0] is not None else 0):
            key = tuple(w[k : k + width])
            firsts[key] = min(firsts.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w, gone = (r[1] or "").split(), set()
        for k in range(len(w) - width + 1 if r[0] is not None else 0):
            if firsts[tuple(w[k : k + width])] < r[0]:
                gone.update(range(k, k + width))
        if gone:
            t = " ".join(x for k, x in enumerate(w) if k not in gone)
            r = (r[0], t, *r[2:4], len(t), *r[5:])
        out.append(r)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def made(spark):
    rows = corpus(random.Random(11))
    return rows, materialise(spark.createDataFrame(rows, SCHEMA))


def test_near_dedup_equals_brute_force(spark, sf, made):
    rows, docs = made
    left = rows_of(L.near_dedup(spark, docs, sf))
    want = slow_near_dedup(rows)
    assert len(left) == len(want) and all(sum(r in g for r in left) == 1 for g in want)
    three = [(1, "t t t t t t"), (2, "t t t t t t"), (2, "other"), (3, "u u u u u v"), (3, "u u u u u v"), (None, "other"), (None, None)]
    three = spark.createDataFrame(three, "doc_id long, text string")
    assert rows_of(L.near_dedup(spark, three, sf)) == [(1, "t t t t t t"), (2, "other"), (3, "u u u u u v"), (None, None)]


def test_repeats_equal_brute_force(spark, sf, made):
    rows, docs = made
    assert rows_of(L.repeats(spark, docs, sf)) == slow_repeats(rows)


def walk(model, x):
    total = model.bias
    for node in model.roots:
        while model.left[node] != node:
            node = model.right[node] if x[model.feature[node]] > model.threshold[node] else model.left[node]
        total += model.value[node]
    return total


def slow_features(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    repeat = len({k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(8)})
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, m, size = len(w), max(1, len(w)), max(1, len(text.encode()))
    return n, repeat, [
        np.log1p(n), sum(map(len, w)) / m, len(re.findall("[#*$%&|<>]", text)) / m, (len(lines) - len(set(lines))) / max(1, len(lines)), repeat / m,
        len(re.findall("[A-Z]", text)) / size, len(re.findall("[0-9]", text)) / size, len(re.findall("[-.,;:!?'\"()]", text)) / size, len(set(w)) / m,
        max((len(x.encode()) for x in w), default=0), text.count("|") / m, text.count("!!") / m, n / max(1, len(lines)),
    ]


def test_quality_equals_brute_force(spark, sf, made):
    rows, docs = made
    real, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(real, labels)
    both = docs.select("doc_id", "text").union(real.select("doc_id", "text"))
    got = sorted((str(r.doc_id), r.text or "", r.base_failed, r.kept, round(r.quality_p, 9)) for r in Q.score(both, model, extra=("text",)).collect())
    want = []
    for r in both.collect():
        n, repeat, x = slow_features(r.text)
        failed, p = n < 20 or 100 * repeat > 30 * n, walk(model, x)
        want.append((str(r.doc_id), r.text or "", failed, not failed and p >= 0, round(float(1 / (1 + np.exp(-p))), 9)))
    assert got == sorted(want)
    assert Q.score(docs.limit(0), model).count() == 0


def slow_severity(model, text):
    w = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    w = {x.encode() for x in w}
    found = set(w)
    for size in (4, 6):
        for start in {x[:size] for x in w if len(x) > size}:
            n = sum(x[:size] == start and len(x) > size for x in w)
            found |= {mark + start for mark, least in ((b"^", 1), (b"^^", 2), (b"^^^", 4), (b"^^^^", 8)) if n >= least}
    x = sum(model.weights.get(f, 0.0) for f in found)
    return sum(1 / (1 + np.exp(c - x)) for c in model.cuts), 1 / (1 + np.exp(model.cuts[0] - x))


def test_toxicity_equals_brute_force(spark, made):
    sf = "/root/testdata/sf0.01"
    rows, docs = made
    real, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(real, labels)
    both = docs.select("doc_id", "text").union(real.select("doc_id", "text").where("doc_id % 7 = 0"))
    for r in X.score(both, model, extra=("text",)).collect():
        severity, p = slow_severity(model, r.text)
        assert abs(r.expected_severity - severity) < 1e-6 and abs(r.toxic_p - p) < 1e-6 and r.kept == (r.toxic_p < X.THRESHOLD) != r.toxic
    assert X.score(docs.limit(0), model).count() == 0


def test_whole_pipeline(spark, sf, tmp_path):
    real, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(i, t, l, s, n) for i, t, l, s, n, _, _ in corpus(random.Random(4))], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = real.select("doc_id", "text", "lang", "source", "n_chars").union(odd).withColumn("component_id", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = rows_of(docs)
    quality, toxic = Q.fit(docs, labels), X.fit(docs.where("doc_id >= 0"), labels)
    one = [r for r in rows if (f := slow_features(r[1]))[0] >= 20 and 100 * f[1] <= 30 * f[0] and walk(quality, f[2]) >= 0]
    kept = materialise(L.quality(spark, docs, str(tmp_path)))
    assert rows_of(kept) == one and kept.columns == docs.columns
    toxic = X.fit(kept, labels)
    two = [r for r in one if slow_severity(toxic, r[1])[1] < X.THRESHOLD]
    kept = materialise(L.toxic(spark, kept, str(tmp_path)))
    assert rows_of(kept) == two and kept.columns == docs.columns
    kept = materialise(L.near_dedup(spark, kept, str(tmp_path)))
    three = rows_of(kept)
    groups = slow_near_dedup(two)
    assert len(three) == len(groups) and all(sum(r in g for r in three) == 1 for g in groups) and kept.columns == docs.columns
    kept = materialise(L.repeats(spark, kept, str(tmp_path)))
    four = rows_of(kept)
    assert four == slow_repeats(three) and kept.columns == docs.columns
    packed = L.run(spark, str(tmp_path)).collect()
    assert sum(r.n_words for r in packed) == sum(len((r[1] or "").split()) for r in four)
    per = {}
    for r in packed:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_words
    assert per.keys() == {r[0] for r in four if (r[1] or "").split()}


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert L.run(spark, str(tmp_path)).count() == 0
