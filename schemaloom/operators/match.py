"""Name matching at three levels and optimal one-to-one assignment inside scopes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from schemaloom.functions.text import normalize

M2_THRESHOLD, M3_THRESHOLD = 0.85, 0.55


def match_exact(gold: DataFrame, induced: DataFrame) -> DataFrame:
    """(scope, norm, gold, induced): one-to-one pairs with equal norm; both sides (scope, id, norm).

    The k-th of a norm on one side meets the k-th on the other: an equi-join, and an optimal assignment at M1."""
    def ranked(df, name):
        w = Window.partitionBy("scope", "norm").orderBy("id")
        return df.select("scope", "norm", F.col("id").alias(name), F.row_number().over(w).alias("k"))

    return ranked(gold, "gold").join(ranked(induced, "induced"), ["scope", "norm", "k"]).drop("k")


def indel(a: str, b: str) -> float:
    """2 x longest common subsequence / total length; 1 for two empty strings. The zeros of a bit vector over b count
    the subsequence, so the work is a few operations on whole numbers for each character of a."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    full = bits = (1 << len(b)) - 1
    for c in a:
        hit = bits & places.get(c, 0)
        bits = ((bits + hit) | (bits - hit)) & full
    return 2 * (len(b) - bits.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    common, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max(indel(one, two), indel(common, one) if both else 0.0, indel(common, two) if both else 0.0)


@lru_cache(100_000)
def fuzzy(a: str, b: str) -> float:
    """1 for equal norms; else the smaller of both ratios, so that one name inside another doesn't tie."""
    return 1.0 if a == b else min(token_set_ratio(a, b), token_sort_ratio(a, b))


def lexicon(pack: dict[str, list[str]]) -> frozenset[tuple[str, str]]:
    """Pairs (a, b) both ways between a norm and each of its synonyms; not among the synonyms of one. ``pack`` is in norms."""
    rows = [(k, s) for k, many in pack.items() for s in many]
    return frozenset(rows + [(b, a) for a, b in rows])


def m2_scorer(pack: dict[str, list[str]]):
    """Score of two norms at M2: 1 if they are equal or synonyms, else fuzzy."""
    known = lexicon(pack)
    return lambda a, b: 1.0 if (a, b) in known else fuzzy(a, b)


def m3_score(a, b) -> float:
    """Score of two (norm, vector) structs at M3: 1 for equal norms, else the cosine; no lexicon. Without a cosine
    (a null, empty or zero vector, unequal lengths) -1, which is under any threshold."""
    if a["norm"] == b["norm"]:
        return 1.0
    if a["vector"] is None or b["vector"] is None or len(a["vector"]) != len(b["vector"]):
        return -1.0
    x, y = np.asarray(a["vector"], float), np.asarray(b["vector"], float)
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    score = float(x @ y) / size if size else -1.0
    return score if np.isfinite(score) else -1.0


def match_cosine(gold: DataFrame, induced: DataFrame, vectors: DataFrame, threshold: float = M3_THRESHOLD) -> DataFrame:
    """(scope, gold, induced, score) at M3: both sides (scope, id, norm), vectors (norm, vector), one for each norm."""
    side = lambda df: df.join(vectors, "norm", "left").select("scope", "id", F.struct("norm", "vector").alias("value"))
    return match_scored(side(gold), side(induced), m3_score, threshold)


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the largest sum; shortest augmenting paths, n^2 m."""
    if 0 in score.shape:
        return []
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        slack, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            free = np.flatnonzero(~done)
            reduced = cost[owner[j] - 1, free - 1] - u[owner[j]] - v[free]
            better = reduced < slack[free]
            slack[free[better]], way[free[better]] = reduced[better], j
            k = free[np.argmin(slack[free])]
            step = slack[k]
            u[owner[done]] += step
            v[done] -= step
            slack[free] -= step
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def match_scored(gold: DataFrame, induced: DataFrame, scorer, threshold: float, masked: bool = False) -> DataFrame:
    """(scope, gold, induced, score): the best assignment of each scope over raw scores, pairs under the threshold
    dropped afterwards (``masked``: set to zero before). Both sides (scope, id, value). Scopes are small by nature;
    many run in parallel. Equal sums go to more exact pairs, then to smaller ids with smaller ones."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("id"), right.sort_values("id")
        raw = np.array([[scorer(a, b) for b in right["value"]] for a in left["value"]], float).reshape(len(left), len(right))
        used = np.where(raw >= threshold, raw, 0.0) if masked else raw
        n, m = raw.shape
        order = np.outer(np.arange(n, 0, -1), np.arange(m, 0, -1)) / max(1, n * m)
        pairs = [(i, j) for i, j in assign(used + 1e-9 * (raw == 1.0) + 1e-11 * order) if raw[i, j] >= threshold]
        rows = [(left["scope"].iloc[i], left["id"].iloc[i], right["id"].iloc[j], raw[i, j]) for i, j in pairs]
        return pd.DataFrame(rows, columns=["scope", "gold", "induced", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in gold.schema}
    return gold.groupBy("scope").cogroup(induced.groupBy("scope")).applyInPandas(run, f"scope {kinds['scope']}, gold {kinds['id']}, induced {induced.schema['id'].dataType.simpleString()}, score double")


@dataclass(frozen=True)
class Pack:
    """What a domain brings to matching: synonyms, thresholds and the embedding model's identity."""

    synonyms: tuple[tuple[str, str], ...] = ()
    stopwords: tuple[str, ...] = ()
    m2_threshold: float = M2_THRESHOLD
    m3_threshold: float = M3_THRESHOLD
    model_name: str = "hashed-ngrams"
    model_version: str | None = None
    cache_path: str | None = None


def scorer_of(level: str, pack: Pack) -> tuple:
    """(score of two values, threshold) of a level; values are norms, at M3 (norm, vector) structs."""
    if level == "M1":
        return lambda a, b: float(a == b), 1.0
    if level == "M2":
        known = frozenset(pack.synonyms) | frozenset((b, a) for a, b in pack.synonyms)
        return lambda a, b: 1.0 if (a, b) in known else fuzzy(a, b), pack.m2_threshold
    if level == "M3":
        return m3_score, pack.m3_threshold
    raise ValueError(f"no matching level {level!r}")


def match(gold: DataFrame, induced: DataFrame, level: str, pack: Pack = Pack(), vectors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """(scope, gold, induced, score): one-to-one pairs of a level inside each scope; both sides (scope, id, name).

    M1 is an equi-join on the norm. M2 and M3 solve the assignment of each scope over all its scores. M3 takes
    vectors(norm, vector)."""
    scorer, threshold = scorer_of(level, pack)
    normed = lambda df: df.select("scope", "id", normalize(F.col("name")).alias("norm"))
    gold, induced = normed(gold), normed(induced)
    if level == "M1":
        return match_exact(gold, induced).select("scope", "gold", "induced", F.lit(1.0).alias("score"))
    if level == "M2":
        value = lambda df: df.withColumnRenamed("norm", "value")
    elif vectors is None:
        raise ValueError("M3 takes vectors")
    else:
        value = lambda df: df.join(vectors.select("norm", "vector"), "norm", "left").select("scope", "id", F.struct("norm", "vector").alias("value"))
    return match_scored(value(gold), value(induced), scorer, threshold, masked)


def hashed_ngrams(norm: str, width: int = 256) -> list[float]:
    """A vector of a text's character 1- to 3-grams, hashed: the embedder that needs no model."""
    v = np.zeros(width)
    padded = f" {norm} "
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            h = int.from_bytes(blake2b(padded[k : k + n].encode(), digest_size=8).digest(), "little")
            v[h % width] += 1 - 2 * (h >> 63)
    size = float(np.linalg.norm(v))
    return (v / size if size else v).tolist()


def embed(norms: DataFrame, cache: DataFrame | None, encode=hashed_ngrams, model_name: str = "hashed-ngrams", model_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors(norm, vector), fresh): vectors of the distinct norms(norm), from cache(model_name, model_version, norm,
    vector) where it has them under this model and version, else encoded once; ``fresh`` are the new rows for the cache."""
    wanted = norms.select("norm").where("norm is not null").distinct()
    mine = F.col("model_name").eqNullSafe(F.lit(model_name)) & F.col("model_version").eqNullSafe(F.lit(model_version).cast("string"))
    known = cache.where(mine).groupBy("norm").agg(F.first("vector").alias("vector")) if cache is not None else None
    missing = wanted.join(known, "norm", "left_anti") if known is not None else wanted

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"norm": b["norm"], "vector": [[float(x) for x in encode(n)] for n in b["norm"]]})

    made = missing.mapInPandas(run, "norm string, vector array<double>")
    fresh = made.select(F.lit(model_name).alias("model_name"), F.lit(model_version).cast("string").alias("model_version"), "norm", "vector")
    vectors = wanted.join(known, "norm").select("norm", F.col("vector").cast("array<double>").alias("vector")).union(made) if known is not None else made
    return vectors, fresh


def synonym_pairs(pack: dict[str, list[str]], spark) -> DataFrame:
    """(a, b) both ways between a key and each of its synonyms; not among the synonyms of one key."""
    return spark.createDataFrame(sorted(lexicon(pack)), "a string, b string")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unmatched(side: DataFrame, matched: DataFrame, name: str) -> DataFrame:
    return side.join(matched.select("scope", F.col(name).alias("id")), ["scope", "id"], "left_anti")
