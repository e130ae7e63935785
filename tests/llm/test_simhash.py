import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from schemaloom.llm import simhash_dedup as S
from schemaloom.llm.components import components
from schemaloom.llm.gray_index import GrayIndex, gray_rank


def closure(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("n,spread", [(1, 4), (2, 1), (60, 6), (900, 10), (700, 3)])
def test_index_equals_brute_force(n, spread):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    codes = set()
    while len(codes) < n:
        c = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    codes = np.array(sorted(codes), np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    want = closure(n, [(i, j) for i in range(n) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 3])
    assert GrayIndex(codes).components(3).tolist() == want


def test_gray_rank_orders_neighbours():
    rank = np.arange(1 << 10, dtype=np.uint64)
    assert (gray_rank(rank ^ (rank >> np.uint64(1))) == rank).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_on_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "one two"), (9010, "ONE Two"), (9011, "É é Z \x1c z\u00a0Z"), (9012, "é é z"), (9006, "é ü 漢"), (9006, "é ü 漢"), (9007, "w " * 30000), (None, "one")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("fp", F.lit("clash"))
    rows = docs.select("doc_id", "text").collect()
    f = [slow_fingerprint(r.text) if r.text is None or len(r.text) < 50000 else None for r in rows]
    f = [S.fingerprint(r.text.encode()) % 2**64 if x is None else x for r, x in zip(rows, f)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))
    want = closure(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (f[order[a]] ^ f[order[b]]).bit_count() <= 3])
    want = sorted((rows[order[a]].doc_id or -1, f[order[a]], rows[order[want[a]]].doc_id) for a in range(len(rows)))
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in S.groups(docs).collect())
    assert [(a if a else -1, b, c) for a, b, c in want] == [(a if a else -1, b, c) for a, b, c in got]


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), seed=42)


def test_empty_table(spark):
    assert S.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_equal_brute_force(spark, sf):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", "  ", "one two", "one two", "one two three"]
    for _ in range(30):
        w = [word() for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(w))
        for share in (0.002, 0.01, 0.02, 0.05, 0.2):
            texts.append(" ".join(word() if rng.random() < share else x for x in w))
    texts += ["same " * 50, "same " * 60, "x y z " * 40 + "end"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, texts[8], "x")], "doc_id long, text string, group string")

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    alike = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    want = closure(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    got = S.similar_groups(docs).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == dict(enumerate(want))
    assert [r.component_id for r in got if r.doc_id is None] == [want[8]]
    assert S.similar_groups(docs.limit(0)).count() == 0


def test_copies_unlike_one_another_join_their_original(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(300):
        w = list(base)
        for k in rng.sample(range(20, 280), 6):
            w[k] = word()
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = [i for i in range(301) if alike(sets[0], sets[i])]
    assert len(near) > 290 and not alike(sets[1], sets[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (S.TILE, 32):
        got = {r.doc_id: r.component_id for r in S.similar_groups(docs, tile=tile).collect()}
        assert sum(got[i] == 0 for i in near) >= 0.99 * len(near)


@pytest.mark.parametrize("seed", [201, 698, 2761])
def test_alike_over_the_last_radius(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    a = [word() for _ in range(300)]
    b = list(a)
    for k in rng.sample(range(20, 280), 6):
        b[k] = word()
    x, y = (S.sketch(" ".join(w).encode(), 5) for w in (a, b))
    assert S.jaccard(x[3], y[3]) >= 0.8 and ((x[1] ^ y[1]) % 2**64).bit_count() > S.RADII[-1]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert [r.component_id for r in S.similar_groups(docs).collect()] == [1, 1]


def test_contract_over_every_document(spark):
    """op7 as its contract reads, over all rows of a table."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows.sort()
    want = closure(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 3])
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.op7_simhash_dedup(spark, sf).collect())
    assert got == [(i, f"{f:016x}", rows[c][0]) for (i, f), c in zip(rows, want)]


@pytest.mark.parametrize("group,size", [(4, 16), (1 << 11, 50), (64, 1 << 16)])
def test_links_over_ranges_equal_brute_force(spark, group, size):
    rng = random.Random(size)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    codes = sorted(codes)
    want = closure(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    classes = spark.createDataFrame([(i, c - (c >> 63 << 64)) for i, c in enumerate(codes)], "rep long, fp long")
    links = [tuple(r) for r in S.near_links(classes, group=group, size=size).collect()]
    assert all((codes[a] ^ codes[b]).bit_count() <= 3 or want[a] == want[b] for a, b in links)
    assert closure(len(codes), links) == want
