"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one Arrow pass over the whole table. The trees are trained on a bounded sample
of labelled rows (``TRAIN_ROWS``, lowest id hashes first), constrained to be monotone in chosen
statistics, and flattened into numpy node arrays, with which each batch is scored at once. The model
is a few kilobytes and travels in the task closure.

Null, empty and blank texts have counts of zero and fail the base rules; texts are read whole, whatever their length, in
time that grows with it. Every row, repeated ones and those with a null id too, gives one row; an empty table none. Without
labelled rows, or with labels of one kind only, the base rules and that kind decide. In training, rows of a doc_id that has
several labels take the largest, rows that tie on all features and label are interchangeable, and of splits with equal gain
the first feature and lowest threshold is taken. Other columns of the table, whatever their names, are passed on if asked
for and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from schemaloom.llm.common import WordHashes, as_bytes, covered, slices, table, window_hashes

#: Most labelled rows used for training.
TRAIN_ROWS = 6000
#: Features and the direction in which more of it may move the score: -1 never up, 1 never down, 0 free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1),
    ("digit_share", 0), ("punct_share", 0), ("distinct_share", 1), ("longest_word", 0), ("pipe_share", -1), ("shout_share", -1), ("line_words", 0),
)
BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_CONT = bytes(range(0x80, 0xC0))
_SPACE = b"\t\n\x0b\x0c\r "
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"


class Statistics:
    """Statistics of one text at a time: the five base counts, then the features."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: bytes | None) -> tuple[tuple, tuple]:
        text = text or b""
        words = text.split()
        n, size = len(words), max(1, len(text))
        count = lambda chars: len(text) - len(text.translate(None, chars))
        chars = len(text.translate(None, _SPACE + _CONT))
        symbols = count(b"#*$%&|<>")
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        repeat = 0
        h = self.hashes.of(words)
        if n >= 9:
            _, inverse, times = np.unique(window_hashes(h, 8), return_inverse=True, return_counts=True)
            if len(times) < n - 7:
                repeat = int(covered(np.flatnonzero(times[inverse] > 1), 8, n).sum())
        m = max(1, n)
        features = (
            np.log1p(n), chars / m, symbols / m, dup / max(1, len(lines)), repeat / m, count(_UPPER) / size, count(_DIGIT) / size, count(_PUNCT) / size,
            len(set(words)) / m, max(map(len, words), default=0), text.count(b"|") / m, text.count(b"!!") / m, n / max(1, len(lines)),
        )
        return (n, chars, symbols, dup, repeat), features


class Trees:
    """Boosted trees in flat arrays: feature, threshold, left and right child and value by node."""

    def __init__(self, feature, threshold, left, right, value, roots, depth, bias):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.depth, self.bias = roots, depth, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of x; all trees walk down together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[at]] > self.threshold[at]
            at = np.where(right, self.right[at], self.left[at])  # a leaf is its own child
        return self.bias + self.value[at].sum(1)


def train(x: np.ndarray, y: np.ndarray, monotone, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0) -> Trees:
    """Second-order boosting of histogram trees for the logistic loss.

    A split on a constrained feature is allowed only if its two values are in the right order, and
    below it each side's values are held at the split's middle, which keeps whole trees monotone.
    Without rows, or with one class only, the trees are empty and the bias decides.
    """
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    p = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    f = np.full(len(y), bias)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1) if len(y) else None

    def node(rows, g, h, low, high, left_depth):
        at = len(arrays["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            arrays[k].append(v)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for j, e in enumerate(edges) if left_depth and len(rows) >= 2 * least else ():
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (j, k, (vl[k] + vr[k]) / 2))
        if best[1] is None:
            value = float(np.clip(-gs / (hs + ridge), low, high)) * rate
            arrays["value"][at] = value
            f[rows] += value
            return at
        j, k, middle = best[1]
        right = binned[rows, j] > k
        bounds = [(low, high), (low, high)]
        if monotone[j] > 0:
            bounds = [(low, middle), (middle, high)]
        elif monotone[j] < 0:
            bounds = [(middle, high), (low, middle)]
        arrays["feature"][at], arrays["threshold"][at] = j, edges[j][k]
        arrays["left"][at] = node(rows[~right], g, h, *bounds[0], left_depth - 1)
        arrays["right"][at] = node(rows[right], g, h, *bounds[1], left_depth - 1)
        return at

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            roots.append(node(np.arange(len(y)), q - y, q * (1 - q), -np.inf, np.inf, depth))
    as_array = lambda k, t: np.array(arrays[k], t)
    return Trees(as_array("feature", np.int64), as_array("threshold", float), as_array("left", np.int64), as_array("right", np.int64), as_array("value", float), np.array(roots, np.int64), depth, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, lowest hashes of doc_id first; ties by id.

    The sample of ids is bounded by ``rows``, so it is broadcast. Of the texts of an id that repeats in ``docs`` the one
    with the smallest hash is taken, so the rows are bounded by ``rows`` too.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Train on labels(doc_id, quality 0/1)."""
    sample = labelled_sample(docs, labels, "quality", rows)
    width = len(FEATURES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Statistics()
        for b in batches:
            x = [list(map(float, stats(t)[1])) for t in as_bytes(b.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.select("text", "y").mapInArrow(features, "x array<double>, y double").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, width)
    order = np.lexsort((got["y"].to_numpy(), *x.T[::-1]))
    return train(x[order], got["y"].to_numpy(float)[order], [m for _, m in FEATURES])


def score(docs: DataFrame, model: Trees, threshold: float = 0.5, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, probability of good quality and kept; ``extra`` columns pass through."""
    cut = float(np.log(threshold / (1 - threshold)))
    made = [*((c, LongType()) for c in BASE_FIELDS), ("base_failed", BooleanType()), ("quality_p", DoubleType()), ("kept", BooleanType())]
    kept = ["doc_id", *extra]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(c, t) for c, t in made])
    sent = kept if "text" in kept else [*kept, "text"]
    at = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Statistics()
        for b in slices(batches):
            made = [stats(t) for t in as_bytes(b.column(at)).to_pylist()]
            base = np.array([m[0] for m in made], np.int64)
            logit = model.score(np.array([m[1] for m in made], float))
            failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
            cols = [*b.columns[: len(kept)], *(pa.array(c) for c in base.T), pa.array(failed), pa.array(1 / (1 + np.exp(-logit))), pa.array(~failed & (logit >= cut))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = schema.fieldNames()
    return docs.select(*sent).mapInArrow(run, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
