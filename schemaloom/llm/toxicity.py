"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(severity >= k) = sigmoid(w.x - cut_k) with one weight vector shared by all thresholds and ordered cuts.
Features are the distinct words of a text and beginnings of words with the number of words that share them. Labels say toxic or not; training
grades toxic texts 1 to ``GRADES`` - 1 by thirds of the share of their words that lean toxic, and others 0.
The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, lowest id hashes first) and keeps
at most ``MAX_FEATURES`` features. Scoring is one Arrow pass.

Null, empty and blank texts have no features: their severity is that of a text without known words. Texts are read whole,
whatever their length. Every row, repeated ones and those with a null id too, gives one row; an empty table none. Without
labelled rows, or with labels of one kind only, nothing is toxic. Features that tie are taken in the order of their bytes.
Other columns of the table, whatever their names, are passed on if asked for and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from schemaloom.llm.common import as_bytes, discard, map_rows, materialise, slices, table
from schemaloom.llm.quality_rules import labelled_sample

#: Most labelled rows used for training, and most features kept.
TRAIN_ROWS, MAX_FEATURES = 12000, 2000
GRADES = 4
#: Texts with at least this P(severity >= 1) are toxic.
THRESHOLD = 0.3
#: Lengths in bytes of the beginnings of words that are features.
PREFIXES = (4, 6)
_MARKS = ((b"^", 1), (b"^^", 2), (b"^^^", 4), (b"^^^^", 8))
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: bytes | None) -> set[bytes]:
    """Distinct words; beginnings of words, each with how many distinct words share it (1, 2, 4, 8 or more)."""
    words = set((text or b"").translate(_FOLD).split())
    found = set(words)
    for size in PREFIXES:
        for start, n in Counter([w[:size] for w in words if len(w) > size]).items():
            for mark, least in _MARKS:
                if n >= least:
                    found.add(mark + start)
    return found


class Ordinal:
    """Weights by feature, ordered cuts."""

    def __init__(self, weights: dict[bytes, float], cuts: list[float]):
        self.weights, self.cuts = weights, cuts

    def __call__(self, text: bytes | None) -> tuple[float, float, int]:
        """Expected severity, P(severity >= 1) and the most likely grade."""
        w = self.weights
        x = sum(w[f] for f in features(text) & w.keys())
        above = [1 / (1 + np.exp(np.clip(c - x, -500, 500))) for c in self.cuts]
        grade = int(np.argmax(-np.diff([1.0, *above, 0.0])))
        return float(sum(above)), float(above[0]), grade


def train(cols: list[np.ndarray], sizes: np.ndarray, toxic: np.ndarray, names: list[bytes], lean: np.ndarray, rounds: int = 300, rate: float = 0.1, ridge: float = 5e-4) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood.

    ``cols``: for each text the places in ``names`` of its features; ``sizes``: how many features it has in all;
    ``lean``: by feature, how much more often toxic texts have it (difference of log shares).
    Without both classes nothing is toxic.
    """
    n = len(cols)
    if not n or toxic.min() == toxic.max():
        return Ordinal({}, [20.0 + k for k in range(GRADES - 1)])
    col, row = np.concatenate(cols).astype(np.int64), np.repeat(np.arange(n), [len(c) for c in cols])
    toxic_word = (lean > 2).astype(float)
    share = np.bincount(row, toxic_word[col], n) / np.maximum(1, sizes)
    steps = np.quantile(share[toxic], np.linspace(0, 1, GRADES)[1:-1])
    y = np.where(toxic, 1 + np.searchsorted(steps, share), 0)
    above = (y[:, None] >= np.arange(1, GRADES)).astype(float)
    # Parameters: weights, first cut, logs of the gaps between cuts (so cuts stay ordered).
    w, p = np.zeros(len(names)), np.r_[2.0, np.zeros(GRADES - 2)]
    m, v = np.zeros(len(w) + len(p)), np.zeros(len(w) + len(p))
    for t in range(1, rounds + 1):
        gaps = np.exp(p[1:])
        cuts = p[0] + np.r_[0.0, np.cumsum(gaps)]
        x = np.bincount(row, w[col], n)
        d = 1 / (1 + np.exp(np.clip(cuts - x[:, None], -500, 500))) - above
        by_cut = -d.mean(0)
        grad = np.r_[np.bincount(col, d.sum(1)[row], len(w)) / n + ridge * w, by_cut.sum(), np.cumsum(by_cut[::-1])[::-1][1:] * gaps]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, p = w - step[: len(w)], p - step[len(w) :]
    cuts = p[0] + np.r_[0.0, np.cumsum(np.exp(p[1:]))]
    return Ordinal({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, cuts.tolist())


def leaning(bags: DataFrame, n: int, n1: int) -> DataFrame:
    """bags(bag, y) of ``n`` texts, ``n1`` toxic -> (f, lean): the ``MAX_FEATURES`` features in 4 texts or more whose count among toxic texts is furthest from chance."""
    counts = bags.select(F.explode("bag").alias("f"), "y").groupBy("f").agg(F.count("*").alias("seen"), F.sum("y").alias("bad")).where("seen >= 4")
    lean = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("seen") - F.col("bad") + 0.5) / (n - n1 + 1))
    chance = F.col("seen") * (n1 / n)
    return counts.select("f", lean.alias("lean"), ((F.col("bad") - chance) * (F.col("bad") - chance) / (chance + 1)).alias("far")).orderBy(F.desc("far"), "f").limit(MAX_FEATURES).select("f", "lean")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ordinal:
    """Train on labels(doc_id, toxic 0/1).

    Features are counted and chosen on executors; the driver gets at most ``MAX_FEATURES`` names, and for each
    sampled text the 4-byte places of those it has.
    """
    sample = labelled_sample(docs, labels, "toxic", rows).select("text", F.col("y").cast("int").alias("y"))
    bags = materialise(map_rows(sample, lambda: lambda t, y: (sorted(features(t)), y), "bag array<binary>, y int"))
    n, n1 = bags.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    chosen = leaning(bags, n, n1).collect() if 0 < n1 < n else []
    names, lean = [bytes(r["f"]) for r in chosen], np.array([r["lean"] for r in chosen], float)

    def place():
        where = {f: i for i, f in enumerate(names)}
        return lambda bag, y: (np.array([where[f] for f in bag if f in where], np.int32).tobytes(), len(bag), y)

    got = sorted(tuple(r) for r in map_rows(bags, place, "at binary, n long, y int").toLocalIterator()) if names else []
    discard(bags)
    return train([np.frombuffer(a, np.int32) for a, _, _ in got], np.array([k for _, k, _ in got]), np.array([y > 0 for _, _, y in got], bool), names, lean)


def score(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, expected severity (0 to 3), P(toxic), grade, toxic (P >= threshold) and kept (not toxic); ``extra`` columns pass through."""
    kept = ["doc_id", *extra]
    sent = kept if "text" in kept else [*kept, "text"]
    at = sent.index("text")
    out = StructType([docs.schema[c] for c in kept] + [StructField(c, t) for c, t in (("expected_severity", DoubleType()), ("toxic_p", DoubleType()), ("grade", IntegerType()), ("toxic", BooleanType()), ("kept", BooleanType()))])
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                severity, p, grade = (np.array(x) for x in zip(*map(model, as_bytes(b.column(at)).to_pylist())))
                made = [pa.array(x) for x in (severity, p, grade.astype(np.int32), p >= threshold, p < threshold)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=names)

    return docs.select(*sent).mapInArrow(run, out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
