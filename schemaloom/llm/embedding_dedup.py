"""Embedding near-dedup with a pivot-permutation index.

Each vector is described by its nearest reference points in order, nearest first. Reference points are vectors, well
apart, from a sample of ``SAMPLE`` rows, those with the lowest hashes; their number grows with the square root of the
rows, up to ``PIVOTS``. Directions are taken from the sample's mean, so vectors that all lean one way still spread over
the points. The inverted lists hold, by label and pair of points, the vectors that have both among their nearest. Two
vectors are candidates if they share at least two points, and a pair is looked at once only, in the list of its two
smallest shared points, ordered by the places that the list's points have in the permutations: only vectors whose places
add up to about the same are compared. How many nearest points count (``prefix``) and how far the sums may differ
(``slack``) is fitted on the sample: pairs made at the threshold exactly have to be found at a rate of ``FITTED``; where
sixteen points don't reach it there are fewer points, in the end so few that every pair is compared.

Verification is the exact cosine in double precision, by matrix products over tiles of a list; lists of more than ``TILE``
vectors are dealt out as pairs of tiles, so no task holds an unbounded list and no pair is dropped. Tasks return counts
per vector and a spanning forest of the links, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or id, link with
nothing; nor do vectors of different widths. Equal vectors of a label are one class, linked with one another. Repeated ids
stay repeated and count as vectors of their own; every row gives one row, an empty table none. Points at the same distance
go by their number. Other columns of the table, whatever their names, aren't read. Recall against brute force is measured
in the tests and the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from schemaloom.llm.common import materialise, table
from schemaloom.llm.components import components
from schemaloom.llm.gray_index import Forest

THRESHOLD, PIVOTS, SAMPLE, TILE, FITTED = 0.93, 1024, 4096, 2048, 0.98


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, label, v or null if unusable) and classes (rep, label, v, n) of equal usable vectors."""
    v = F.col("embedding").cast("array<double>")
    bad = F.expr("exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) or not exists(v, x -> x <> 0)")
    rows = vectors.select("vec_id", "label", v.alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform("v", lambda x: x + F.lit(0.0))))
    keyed = rows.withColumn("k", F.when(F.col("v").isNotNull(), F.concat_ws("|", F.col("label").cast("string"), F.col("v").cast("string"))))
    keyed = keyed.withColumn("k", F.when(F.col("k").isNotNull(), F.sha2("k", 256)))
    usable = keyed.where("k is not null")
    classes = usable.groupBy("k").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"))
    return keyed.select("vec_id", "k"), materialise(classes)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of very large and very small numbers finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(sample: np.ndarray, most: int, apart: float = 0.5) -> np.ndarray:
    """The first ``most`` rows that are no closer than ``apart`` to an earlier one, so that a group of near
    copies gives one reference point, not many."""
    taken = sample[:1]
    for x in sample[1:]:
        if len(taken) < most and (taken @ x).max() < apart:
            taken = np.vstack([taken, x])
    return taken


class Index:
    """Reference points and how they are used; made once from a bounded sample and sent to the tasks."""

    def __init__(self, pivots: np.ndarray, mean: np.ndarray, prefix: int, slack: int):
        self.pivots, self.mean, self.prefix, self.slack = pivots, mean, prefix, slack

    def permutations(self, x: np.ndarray, prefix: int | None = None) -> np.ndarray:
        """Numbers of each row's nearest points, nearest first; ties by number. Rows are units."""
        away = x - self.mean
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        return np.argsort(-(away @ self.pivots.T), axis=1, kind="stable")[:, : prefix or self.prefix]


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, apart) of pairs of permutations: their two smallest shared points (-1: fewer than two) and how much the sums
    of the places of p and q differ."""
    k = a.shape[1]
    same = a[:, :, None] == b[:, None, :]
    shared = np.where(same.any(2), a, np.iinfo(a.dtype).max)
    order = np.argsort(shared, axis=1, kind="stable")[:, :2]
    row = np.arange(len(a))
    two = shared[row, order[:, -1]] < np.iinfo(a.dtype).max if k > 1 else np.zeros(len(a), bool)
    place = same.argmax(2)
    p, q = (np.where(two, a[row, order[:, j]], -1) for j in (0, -1))
    apart = np.abs(order[:, 0] + order[:, -1] - place[row, order[:, 0]] - place[row, order[:, -1]])
    return p, q, np.where(two, apart, 0)


def fit(sample: np.ndarray, rows: int, threshold: float, most: int = PIVOTS, wanted: float = FITTED) -> Index:
    """The index for ``rows`` vectors from a sample of units: points come from its first half, pairs to try it from the second."""
    mean = sample.mean(0) if len(sample) > 1 else np.zeros(sample.shape[1])
    away = sample[: len(sample) // 2] - mean
    away = away[np.linalg.norm(away, axis=1) > 1e-9]
    rng = np.random.default_rng(1)
    x = sample[len(sample) // 2 :][:1024]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(u, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * u / np.maximum(size, 1e-300)
    m = min(most, max(64, int(np.sqrt(rows / 16))))
    while len(away):
        index = Index(spread(away / np.linalg.norm(away, axis=1, keepdims=True), m), mean, 2, 0)
        m = len(index.pivots)
        if m < 3:
            break
        near = [index.permutations(z, min(m, 16)) for z in (x, y)]
        for prefix in range(4, min(m, 16) + 1):
            p, _, apart = meeting(near[0][:, :prefix], near[1][:, :prefix])
            found = np.where(p >= 0, apart, 1 << 20)
            slack = int(np.quantile(found, wanted, method="inverted_cdf"))
            if slack < 1 << 20:
                index.prefix, index.slack = prefix, slack
                return index
        m //= 2
    return Index(np.zeros((2, sample.shape[1])), mean, 2, 1)  # both points are near everything: one list, all pairs


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def near_counts(classes: DataFrame, index: Index, threshold: float, tile: int = TILE) -> DataFrame:
    """classes(rep, label, v, n), all vectors of the points' width -> rows (rep, links, to): how many vectors
    of other classes link with it, by list, and a link of the list's spanning forest (null: none)."""
    width, m = index.pivots.shape[1], len(index.pivots)
    prefix, slack = index.prefix, index.slack
    pairs = list(combinations(range(prefix), 2))
    kind = classes.schema["label"].dataType

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = index.permutations(unit(_matrix(b.column(2), width))).astype(np.int16)
            wide = near.astype(np.int64)
            keys = np.stack([np.minimum(wide[:, i], wide[:, j]) * m + np.maximum(wide[:, i], wide[:, j]) for i, j in pairs], 1)
            rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), len(pairs))))
            places = pa.array([x.tobytes() for x in np.repeat(near, len(pairs), 0)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), places, *rows.columns], names=["pair", "near", "rep", "label", "v", "n"])

    routed = classes.select("rep", "label", "v", "n")
    element = routed.schema["v"].dataType.simpleString()
    routed = routed.mapInArrow(route, f"pair long, near binary, rep long, label {kind.simpleString()}, v {element}, n long")
    # Sizes of the lists come from the routes alone; a list of more than one tile is dealt out as pairs of tiles.
    sizes = routed.groupBy("label", "pair").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    dealt = routed.join(sizes, ["label", "pair"]).withColumn("t", tiles).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    dealt = dealt.select("label", "pair", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "mine", "near", "rep", "v", "n")

    def join(key, rows):
        _, pair, t1, t2 = (k.as_py() for k in key)
        p, q = divmod(pair, m)
        near = np.frombuffer(b"".join(rows["near"].to_pylist()), np.int16).reshape(-1, prefix)
        total = (near == p).argmax(1) + (near == q).argmax(1)
        order = np.argsort(total, kind="stable")
        near, total = near[order], total[order]
        rep, n, side = (rows[c].to_numpy()[order] for c in ("rep", "n", "mine"))
        x = unit(np.asarray(rows["v"].combine_chunks().flatten(), float).reshape(-1, width))[order]
        links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for a in range(0, len(rep), 512):
            e = min(a + 512, len(rep))
            low, high = np.searchsorted(total, total[a] - slack), np.searchsorted(total, total[e - 1] + slack, "right")
            i, j = np.nonzero(x[a:e] @ x[low:high].T >= threshold)
            i, j = i + a, j + low
            keep = (i != j) & (np.abs(total[i] - total[j]) <= slack)
            if t1 != t2:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            for c in range(0, len(i), 1 << 15):  # in this list a pair counts if p and q are the two smallest that it shares
                ic, jc = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                first, second, _ = meeting(near[ic], near[jc])
                own = (first == p) & (second == q)
                ic, jc = ic[own], jc[own]
                links += np.bincount(ic, n[jc], len(rep)).astype(np.int64)
                forest.link(ic, jc)
        root = forest.roots()
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "to": rep[root[some]]})

    return dealt.groupBy("label", "pair", "t1", "t2").applyInArrow(join, "rep long, links long, to long")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept) for every row."""
    if pivots > np.iinfo(np.int16).max:
        raise ValueError("too many reference points")
    rows, classes = _classes(vectors)
    found = []
    # Components that come as floats are shuffled as floats; all arithmetic is in double precision.
    narrow = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    # Every width that can hold a pair: a number for each, whatever the input. Each takes a plan of its own.
    widths = classes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    for width, rows_of in sorted((r.w, r.n) for r in widths.collect()):
        some = classes.where(F.size("v") == width)
        some = some.withColumn("v", F.col("v").cast("array<float>")) if narrow else some
        sample = some.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("v").collect()
        found.append(near_counts(some, fit(unit(np.array([r.v for r in sample], float)), rows_of, threshold, pivots), threshold, tile))
    blank = vectors.sparkSession.createDataFrame([], "rep long, links long, to long")
    for f in found:
        blank = blank.union(f)
    counts = materialise(blank)
    linked = components(counts.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("k", "rep", "n").join(per, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    named = named.select("k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("k is not null").join(named, "k").select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"))
    alone = rows.where("k is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))  # they stay where they are
    out = out.union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}

ORACLES = {
    "op3_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS component_id,
 vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS kept FROM v"""
}
