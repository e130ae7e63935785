"""Substring dedup by recompression.

Recompression names runs of one token and then, round by round, adjacent pairs of symbols. A name is a
hash of what it stands for and the choice of which pairs join is a function of the two names alone, so
the naming is global: equal substrings get equal interior symbols in every document, on every executor,
without exchanging a name table. For each symbol the words on which its making depends are tracked.

A window of 13 words is represented by its highest symbol that depends on nothing outside the window
(ties: the smallest name); the few windows without one represent themselves. So equal windows always
have equal symbols, and a window can only repeat where its symbol does. Plan:

1. one pass over the texts gives the distinct symbols of each document; an aggregation finds the symbols
   that occur in two documents or more;
2. the windows behind those shared symbols are named by 128 bits, made from the 128-bit names of their words,
   and a second aggregation verifies which of them start in a document with a smaller id; inside one document
   64 bits find them again;
3. the covered words are removed from the texts.

Shuffled are symbols (about a fifth of the words) and the windows behind shared ones, with partial
aggregation, so that a passage in a third of all documents meets in one row per task; the rows of such a
symbol or window stay where they are when the result is joined back.

Null texts and texts without words have no words; texts are read whole, whatever their length. Repeated
doc_ids count as one document: windows are compared by id, so equal rows of an id keep their words. A null
doc_id is nobody's source, and its own windows are never removed. Every row gives one row, an empty table
none. Other columns of the table, whatever their names, are passed on if asked for and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from schemaloom.llm.batch_words import batch_words, chunks
from schemaloom.llm.common import as_bytes, covered, discard, materialise, mix, slices, spread_join, table, window_hashes

WINDOW, ROUNDS = 13, 3
#: Symbols and candidate windows are compared in so many slices of their hashes, one after another, so that the
#: shuffle files of one slice at a time are on disk. All slices are compared.
SLICES = 4
#: Fewer rows than this are compared in one go.
SLICE_ROWS = 1_000_000
_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_SIDES = mix(np.arange(1, 65, dtype=np.uint64))


def recompress(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, start, low, high, level) of the symbols after ``rounds`` rounds over word hashes.

    start: first word; a symbol is made from the words low..high-1 and no others. Words before 0 or after
    the end stand for what may surround the sequence elsewhere.
    """
    n = len(names)
    if not n:
        return names, *(np.empty(0, np.int64) for _ in range(4))
    # Runs: k > 1 equal tokens become one symbol. Each symbol depends on the tokens that end its run.
    start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    size = np.diff(np.r_[start, n])
    name = names[start]
    name = np.where(size > 1, mix(name ^ mix(size.astype(np.uint64) * _RUN)), name)
    low, high = start - 1, start + size + 1
    level = np.zeros(len(name), np.int64)
    for r in range(rounds):
        side = (mix(name ^ _SIDES[r]) & np.uint64(1)).astype(bool)  # True: may join its right neighbour
        pair = np.r_[side[:-1] & ~side[1:], False]
        second = np.r_[False, pair[:-1]]
        with_right, with_left = pair | side, ~side & ~second
        # A symbol depends on the neighbour that it joins, or that might have joined it.
        right_low, right_high = np.r_[low[1:], n], np.r_[high[1:], n + 1]
        left_low, left_high = np.r_[-1, low[:-1]], np.r_[0, high[:-1]]
        new_low = np.where(with_right, np.minimum(low, right_low), np.where(with_left, np.minimum(low, left_low), low))
        new_high = np.where(with_right, np.maximum(high, right_high), np.where(with_left, np.maximum(high, left_high), high))
        new_name = np.where(pair, mix(name * _PAIR + mix(np.r_[name[1:], name[:1]] + _RUN)), name)
        new_level = np.where(pair, r + 1, level)
        keep = ~second
        name, start, low, high, level = new_name[keep], start[keep], new_low[keep], new_high[keep], new_level[keep]
    return name, start, low, high, level


def window_symbols(words: np.ndarray, windows: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The symbol that stands for each window; ``windows``: the windows' own hashes."""
    n, m = len(words), len(windows)
    name, _, low, high, level = recompress(words, rounds)
    inside = (high - low <= width) & (low >= 0) & (high <= n)
    name, low, high, level = name[inside], low[inside], high[inside], level[inside]
    # A rank orders symbols by level, then name; of those that begin to depend at one word and end at another only the best counts.
    rank = ((np.uint64(rounds) - level.astype(np.uint64)) << np.uint64(62)) | (mix(name) >> np.uint64(2))
    reach = np.full((width + 1, n + width), np.iinfo(np.uint64).max)
    np.minimum.at(reach, (high - low, low), rank)
    best = np.minimum.accumulate(reach, axis=0)  # by first word: the best that needs at most so many words
    out = np.full(m, np.iinfo(np.uint64).max)
    for k in range(width):
        np.minimum(out, best[width - k, k : k + m], out=out)
    return np.where(out == np.iinfo(np.uint64).max, windows, out)


def _windows(texts: list[bytes | None], width: int):
    """(half, words, windows, ends, whole): ``half`` of ``batch_words``; the first halves of the names of all texts' words
    and windows, a separator after each text at ``ends``; the places of the windows without a separator."""
    half, ends = batch_words(texts)
    words = half(0)
    windows = window_hashes(words, width)
    before = np.zeros(len(words) + 1, np.int64)
    before[ends + 1] = 1
    before = np.cumsum(before)
    whole = before[width:] == before[: len(before) - width] if len(windows) else np.empty(0, bool)
    return half, words, windows, ends, np.flatnonzero(whole)


def symbols(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(s, doc_id): the symbols that stand for each document's windows, side-by-side repeats once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for at, texts in chunks(as_bytes(b.column(1)).to_pylist()):
                _, words, windows, ends, whole = _windows(texts, width)
                if not len(whole):
                    continue
                s, doc = window_symbols(words, windows, width, rounds)[whole], np.searchsorted(ends, whole)
                new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]
                ids = b.column(0).take(pa.array(at + doc[new]))
                yield pa.RecordBatch.from_arrays([pa.array(s[new].view(np.int64)), ids], names=["s", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "s long, doc_id long")


def _sliced(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("slice", F.pmod(column, F.lit(SLICES)).cast("int"))


def _shared(rows: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Of rows(*keys, doc_id) those whose key several documents have, with the smallest of these (``first_doc``)."""
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc").drop("last_doc")
    found = materialise(found)
    out = materialise(spread_join(rows, found, keys, rows.count()).where(" and ".join(("true", *more))))
    discard(found)
    return out


def _slices(rows: DataFrame) -> list[DataFrame]:
    if rows.count() < SLICE_ROWS:
        return [rows]
    return [rows.where(F.col("slice") == k) for k in range(SLICES)]


def repeated_windows(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, ws array<bigint>): per document the first halves of the names of its windows that start in a document with
    a smaller id, which is enough to find them again inside one document."""
    made = materialise(_sliced(symbols(docs, width, rounds), "s"), by="slice")
    parts = [_shared(part.select("s", "doc_id"), ["s"]).select("doc_id", "s") for part in _slices(made)]
    discard(made)
    wanted = materialise(reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.collect_set("s").alias("ss")))
    discard(*parts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = b.column(2)
            for at, texts in chunks(as_bytes(b.column(1)).to_pylist()):
                half, words, windows, ends, whole = _windows(texts, width)
                s, doc = window_symbols(words, windows, width, rounds)[whole], np.searchsorted(ends, whole)
                keep = np.zeros(len(whole), bool)
                edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    a, e = edge[k], edge[k + 1]
                    keep[a:e] = np.isin(s[a:e], np.asarray(found[at + k].values).view(np.uint64))
                ids = b.column(0).take(pa.array(at + doc[keep]))
                second = window_hashes(half(1), width) if keep.any() else windows
                yield pa.RecordBatch.from_arrays([pa.array(x[whole[keep]].view(np.int64)) for x in (windows, second)] + [ids], names=["w", "v", "doc_id"])

    texts = docs.where("doc_id is not null").select("doc_id", "text").join(wanted, "doc_id")
    found = texts.select("doc_id", "text", "ss").mapInArrow(verify, "w long, v long, doc_id long")
    candidates = materialise(_sliced(found, "w"), by="slice")
    discard(wanted)
    parts = [_shared(part.select("w", "v", "doc_id"), ["w", "v"], ("doc_id > first_doc",)).select("doc_id", "w") for part in _slices(candidates)]
    out = materialise(reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.collect_set("w").alias("ws")))
    discard(candidates, *parts)
    return out


SCHEMA = "n_words long, n_removed long, kept string"


def dedup(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra`` columns, n_words, n_removed and the kept words joined by one space, for every row."""
    found = repeated_windows(docs, width, rounds).select(F.col("doc_id").alias("_found_id"), F.col("ws").alias("_found"))
    kept_columns = ["doc_id", *extra]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept_columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, kept = [], [], []
            found = b.column(1)
            for at, texts in chunks(as_bytes(b.column(0)).to_pylist()):
                words = [(t or b"").split() for t in texts]
                hit = [k for k in range(len(texts)) if found[at + k].is_valid]
                gone = {}
                if hit:
                    _, _, windows, ends, whole = _windows([texts[k] for k in hit], width)
                    doc = np.searchsorted(ends, whole)
                    edge = np.searchsorted(doc, np.arange(len(hit) + 1))
                    for n, k in enumerate(hit):
                        mine = windows[whole[edge[n] : edge[n + 1]]]
                        starts = np.flatnonzero(np.isin(mine, np.asarray(found[at + k].values).view(np.uint64)))
                        gone[k] = covered(starts, width, len(words[k]))
                for k, w in enumerate(words):
                    g = gone.get(k)
                    left = w if g is None else [w[i] for i in np.flatnonzero(~g)]
                    n_words.append(len(w))
                    n_removed.append(len(w) - len(left))
                    kept.append(b" ".join(left))
            by = dict(zip(b.schema.names, b.columns))
            cols = [*(by[c] for c in kept_columns), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept_columns, "n_words", "n_removed", "kept"])

    sent = ["text", "doc_id", *(c for c in extra if c != "text")]
    named = docs.select(*sent).where("doc_id is not null").join(found, F.col("doc_id") == F.col("_found_id"), "left").select("text", "_found", *sent[1:])
    nameless = docs.select(*sent).where("doc_id is null").select("text", F.lit(None).cast("array<long>").alias("_found"), *sent[1:])  # they stay where they are
    joined = named.union(nameless)
    return joined.mapInArrow(cut, f"{kinds}, {SCHEMA}")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

ORACLES = {
    "op8_substring_dedup": f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM p),
 hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
 gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, {WINDOW}) r(k)),
 t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
 k AS (SELECT t.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
}
