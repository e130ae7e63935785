"""Chat formatting, HTML extraction, packing and the pipeline."""

import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import chat_format as C, html_extract as H, packing as P


def test_render_reads_back():
    for text in ("", "\\", "<|", "\\p", "<\\p", "<|im_end|>\n<|im_start|>x", "a\\<|\\\\n|", "<" * 3 + "|"):
        for role in ("user", "odd\nrole", "<|"):
            segment, a, e = C.render(role, text)
            assert C.read_segment(segment) == (role, text) and C.unescape(segment[a:e]) == text
            assert segment.count("<|") == 2


def test_digests(spark):
    rows = [(1, 1, "assistant", "b é"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "<|im_end|>"), (3, 5, "user", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in C.digests(C.segments(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb é\nassistant\n\n") and got[1].loss_sha256 == sha("b é") and got[1].loss_chars == 3
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].loss_chars == 10
    assert C.digests(C.segments(df.limit(0))).count() == 0
    made = {r.target_seq: r for r in C.examples(C.segments(df)).where("conv_id = 1").collect()}
    assert set(made) == {1, 2} and made[1].context == C.render("user", "a")[0] and made[2].context == made[1].context + made[1].target


def test_expansion_streams_every_example(spark, monkeypatch):
    monkeypatch.setattr(C, "ADDED", 3)
    turns = [(1, k, "assistant" if k in (1, 2, 9) else "user", f"t{k} <|") for k in range(12)] + [(2, 0, "user", "x"), (3, 0, "assistant", "y"), (None, 0, "assistant", None)]
    segs = C.segments(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).coalesce(1)
    rows = C.expand(segs).collect()
    made = {(r.conv_id, r.target_seq): r for r in C.examples(segs).collect()}
    text, seen = {}, set()
    for r in rows:
        assert 1 <= len(r.added) <= 4
        whole = text[r.conv_id] = text.get(r.conv_id, "") + "".join(r.added)
        if r.target_seq is not None:
            want = made[r.conv_id, r.target_seq]
            seen.add((r.conv_id, r.target_seq))
            assert whole[r.context_start : r.context_end] == want.context and whole[r.context_end :] == want.target
            assert (r.loss_start, r.loss_end) == (want.loss_start, want.loss_end)
    assert seen == set(made) == {(1, 1), (1, 2), (1, 9), (3, 0), (None, 0)} and text[1].count(C.START) == 12


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav>
<div class="ad">buy</div><article><h1>Head &amp; more</h1><p>One   two<br>three<p>Four <b>five</article><form>x</form><div id="comments"><p>me too</p></div><footer>&copy; x</footer></body>"""


def kept(html):
    return [(t, main) for t, main, furniture in H.lines(html) if not furniture]


def test_lines():
    assert kept(PAGE) == [("Head & more", True), ("One two three", True), ("Four five", True)]
    assert H.lines("") == [] and kept("plain <i>te</i>xt") == [("plain text", False)]
    assert kept("<p>a <span class=ad>buy</span> b</p>c") == [("a b", False), ("c", False)]
    assert kept("a < b <c") == [("a < b <c", False)] and kept('<svg/>x<p title="a>b">y</p>') == [("x", False), ("y", False)]


def test_marks_are_whole_words_of_the_element_itself():
    for around in ('<div class="layout has-sidebar">', '<div class="overflow-hidden">', "<form>", '<div id="sidebar">'):
        assert kept(f"<body>{around}<article>x</article>") == [("x", True)]
    assert kept('<article>a<p class="social-history">b</p><section id="related-work">c</section></article>') == [(x, True) for x in "abc"]
    assert kept('<div class="sidebar"><article>t</article></div><article>m</article>') == [("m", True)]
    for gone in ('class="site-footer"', 'class="x comment-list"', "id=cookie-notice", "hidden", 'style="display: none"', "role=navigation"):
        assert kept(f"<p>a</p><div {gone}>b<p>c</p></div>") == [("a", False)], gone


def test_time_grows_with_the_page():
    for piece in ("<a ", '<a ="x>y" ', '<a "', "<div>", "<b></i>", "<p>", "<!--", "<script>", "<li><b>", '<div class="nav">', "&amp;<"):
        began = time.time()
        H.lines(piece * 50_000)
        assert time.time() - began < 10, piece
    rng = np.random.default_rng(0)
    began = time.time()
    assert 400 < H.shared(rng.permutation(50_000), rng.permutation(50_000)).sum() < 450
    assert time.time() - began < 30


def test_shared_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert H.shared(a, b).sum() == t[-1, -1]


def test_differencing_without_landmarks(spark):
    page = "<body><div>Site name</div><p>Text {0} one.</p><p>Text {0} two.</p><div>Imprint</div></body>"
    rows = [(i, f"http://h.example/en/{i:03}?x", page.format(i)) for i in range(30)] + [(90, "http://other.example/a", page.format(90)), (91, None, page.format(91)), (92, "http://h.example/z", None), (None, "http://h.example/en/001", page.format(5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("prev", F.lit(0))
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"Text {i} one.\nText {i} two." for i in range(30))
    assert got[90].text.startswith("Site name") and got[92].text == "" and H.extract(df.limit(0)).count() == 0


def test_mirrored_articles_stay(spark):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE) for i in range(4)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {"Head & more\nOne two three\nFour five"}


def test_text_outside_the_article_stays(spark):
    page = "<body><div>Site name</div><p>Lead {0}.</p><article><h2>Teaser {0}</h2></article><div>Story {0}.</div><div>Imprint</div></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i:03}", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    got = H.extract(df).collect()
    assert {r.text for r in got} == {f"Lead {i}.\nTeaser {i}\nStory {i}." for i in range(20)}
    assert {r.n_shared for r in got} == {2}


def slow_extract(rows):
    """Differencing as the docstring tells it, page by page."""
    pages = [(re.match("(?:[a-z]+:)?//([^/?#]*)([^?#]*)", u).groups() if u else None, i, H.lines(h or "")) for i, u, h in rows]
    order = sorted((k for k, p in enumerate(pages) if p[0]), key=lambda k: (pages[k][0][0].lower(), pages[k][0][1], pages[k][1] is not None, pages[k][1] or 0))
    out = []
    for k, (where, i, found) in enumerate(pages):
        drop = set()
        if where:
            texts, at, beside = [x[0] for x in found], order.index(k), []
            for step in (-1, 1):
                j = at + step
                while 0 <= j < len(order) and pages[order[j]][0][0].lower() == where[0].lower() and [x[0] for x in pages[order[j]][2]] == texts:
                    j += step
                if 0 <= j < len(order) and pages[order[j]][0][0].lower() == where[0].lower():
                    beside.append(pages[order[j]])
            if beside:
                partner = max(beside, key=lambda p: len(os.path.commonprefix([p[0][1], where[1]])))
                mine, theirs = [n for n, x in enumerate(found) if not x[1]], [x[0] for x in partner[2] if not x[1]]
                hit = H.shared(H._hashes([found[n] for n in mine]), H._hashes([(t,) for t in theirs]))
                drop = {mine[n] for n in np.flatnonzero(hit)}
        out.append((-1 if i is None else i, "\n".join(x[0] for n, x in enumerate(found) if n not in drop and not x[2]), len(drop)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_differencing_equals_brute_force(spark, seed):
    """Pages without landmarks: template lines per host, rows that repeat, mirrors, hosts of one page, odd rows."""
    rng = random.Random(seed)
    rows = []
    for host in ("a.example", "B.example", "one.example"):
        template = [f"<div>{host} {w}</div>" for w in ("home", "about", "imprint", "terms")]
        for k in range(1 if host[0] == "o" else 40):
            body = [f"<p>{rng.choice('xyzuvw')} {rng.randint(0, 3000)}</p>" for _ in range(rng.randint(0, 5))]
            html = "".join(template[:2] + body + rng.sample(template[2:], 2))
            rows.append((len(rows), f"http://{host}/{rng.choice(['en', 'de'])}/{rng.randint(0, 15)}?q={k}", html))
            if rng.random() < 0.4:
                rows += [(len(rows) + n, rows[-1][1], html) for n in range(rng.randint(1, 4))]
    rows += [rows[3], (900, None, rows[5][2]), (901, rows[5][1], None), (902, rows[7][1], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).withColumn("digest", F.lit(0))
    got = sorted((r.page_id, r.text, r.n_shared) for r in H.extract(df).collect())
    assert got == slow_extract(rows)
    assert sum(r[2] for r in got) > 100


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = [(-1, None, "s"), (-2, "", None), (-3, "w " * 5000, None), (-4, "same text", "s"), (-4, "same text", "s"), (None, "x y", "s")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("bin", F.lit(1))
    rows = P.pack(docs, shard_words=20000).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    text = {r.doc_id: r for r in docs.collect()}
    assert sum(r.n_words for r in rows) == sum(len((r.text or "").split()) for r in docs.collect())
    for rs in bins.values():
        rs.sort(key=lambda r: r.position)
        assert sum(r.n_words for r in rs) <= P.CAPACITY
        assert [r.offset for r in rs] == np.cumsum([0] + [r.n_words for r in rs])[:-1].tolist()
        sources = [text[r.doc_id].source for r in rs]
        assert max(map(sources.count, sources)) <= P.SOURCE_QUOTA
        texts = [text[r.doc_id].text for r in rs]
        assert len(set(texts)) == len(texts)
    assert P.pack(docs.limit(0)).count() == 0


def slow_pack(pieces, capacity, quota):
    """The documented rule over a plain list of bins: of those with room and without conflict the one with least room,
    the oldest of equals; else a new one."""
    bins, out = [], []
    for size, source, cluster in pieces:
        free = [b for b in bins if b["room"] >= size and b["s"].count(source) < quota and cluster not in b["c"]]
        b = min(free, key=lambda b: (b["room"], b["n"]), default=None)
        if b is None:
            b = {"n": len(bins), "room": capacity, "s": [], "c": []}
            bins.append(b)
        out.append((b["n"], len(b["s"]), capacity - b["room"]))
        b["room"] -= size
        b["s"].append(source)
        b["c"].append(cluster)
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_equals_brute_force(spark, kind):
    rng = random.Random(3)
    rows = [(i if kind == "long" else f"d{i:04}", " ".join(["w"] * rng.randint(0, 90)) + rng.choice(["", " x", " y"]), rng.choice(["a", "b", None])) for i in range(400)] + [(None, "w w", "a"), (None, "w w w", "a")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
    got = P.pack(docs, capacity=40, quota=2, shard_words=4000).collect()
    text = {(i, len((t or "").split())): (t, s) for i, t, s in rows}
    whole = {}
    for r in got:
        whole[r.doc_id, r.shard] = whole.get((r.doc_id, r.shard), 0) + r.n_words
    assert len({r.shard for r in got}) > 2
    for shard in {r.shard for r in got}:
        mine = [r for r in got if r.shard == shard]
        known = lambda r: next((t, s) for (i, n), (t, s) in text.items() if i == r.doc_id and r.first_word + r.n_words <= n)
        mine.sort(key=lambda r: (-r.n_words, r.doc_id is None, 0 if r.doc_id is None else r.doc_id, r.first_word))
        if any(r.doc_id is None for r in mine):
            continue  # two ids of one name can't be told apart here
        want = slow_pack([(r.n_words, known(r)[1], known(r)[0]) for r in mine], 40, 2)
        assert [(r.bin, r.position, r.offset) for r in mine] == want


def test_repeated_rows_are_spread(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "'a b c d' as text", "'s' as source")
    sizes = sorted(r["count"] for r in P.pack(docs, shard_words=1200).groupBy("shard").count().collect())
    assert len(sizes) == 10 and sizes[-1] < 400 and sum(sizes) == 3000


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = P.Packer(10, 1)
    assert bins.place(6, "a", 1)[0] == 0 and bins.place(7, "b", 2)[0] == 1
    assert bins.place(3, "c", 3)[0] == 1  # the tightest with room
    assert bins.place(2, "a", 4)[0] == 2  # the open one holds this source
    assert bins.place(4, "d", 1)[0] == 2  # and this cluster


def test_pipeline(spark, sf):
    import corpus_pipeline as L

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in L.STAGES[:-1]:
        kept = L.materialise(stage(spark, docs, sf))
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        docs = kept
    assert {r.doc_id for r in L.pack(spark, docs, sf).collect()} <= {r.doc_id for r in docs.collect()}
