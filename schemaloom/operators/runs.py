"""Counts of the runs of words of a whole corpus, in numpy.

A task reads a stretch of tokens at a time and sends its distinct records, each once with its number: a record is a run of
the longest kind, and stands for all shorter ones of three words or more that begin with it; runs of one and two words are
records of their own. Records go to the bucket of their first three words, sorted, as numbers of words, compressed; that
is a few bytes for each token of the corpus, where a row for each run takes about twenty for each of four runs. Buckets are
as many as the corpus needs to keep each small. Common words have numbers that all tasks know; the others are listed with
the records they stand in. Without the former, lists would repeat in every bucket, and grow faster than the corpus. Which
words are common is a matter of size only: all records of all texts are sent, and all words are compared whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Tokens and different words that a task holds at a time.
CHUNK_TOKENS, CHUNK_WORDS = 1 << 21, 1 << 19
#: Characters of text for each bucket.
BUCKET_CHARS = 10_000_000
#: Records that a bucket holds before equal ones are put together.
MERGE_RECORDS = 1_000_000
#: Words that have numbers everywhere, at most, and their longest; they come from the beginnings of texts, about so many characters in all.
COMMON_WORDS, COMMON_LENGTH, COMMON_CHARS, BEGINNING = 1 << 16, 32, 10_000_000, 10_000
#: Texts of so many characters or more may end a chunk anywhere.
LONG_CHARS = 1 << 20

# Ends of sentences as in terms.sentences: white space after . ! or ?, blank lines. A text is in lower case already.
_TOKEN = re.compile(r"[a-z0-9]+|(?<=[.!?])[ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*\n")
_SCHEMA = pa.schema([("bucket", pa.int32()), ("rows", pa.int64()), ("list_size", pa.int64()), ("words", pa.binary()), ("cells", pa.binary())])
_PACKED = "bucket int, rows long, list_size long, words binary, cells binary"


class _Numbers(dict):
    """Numbers of words from 1, common ones first, the others in the order of their first use; 0 for white space, which ends a sentence."""

    def __init__(self, common: Sequence[str] = ()):
        super().__init__(zip(common, range(1, len(common) + 1)))
        self.words = ["", *common]

    def __missing__(self, word: str) -> int:
        if word[0] in " \t\n\x0b\f\r":
            return 0
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _distinct(cols: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, sorted by the first column, then the next, and their numbers (sums of ``counts``)."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64)
    key, size = cols[0].astype(np.int64), int(cols[0].max()) + 1
    for c in cols[1:]:
        more = int(c.max()) + 1
        if size * more >= 1 << 63:
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key *= more
        key += c
        size *= more
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts[order], first)
    return [c[order[first]] for c in cols], n.astype(np.int64)


def _records(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the runs that begin at each place, 0 behind their ends: distinct records and their numbers."""
    zero = np.zeros(0, np.int32)
    parts = [[[zero] * len(cols), np.zeros(0, np.int64)]]
    for width in range(1, len(cols) + 1 if len(cols) < 3 else 4):
        here = cols[width - 1] != 0
        used = len(cols) if width == 3 else width
        found, n = _distinct([c[here] for c in cols[:used]], None)
        parts.append([found + [np.zeros(len(n), np.int32)] * (len(cols) - used), n])
    return [np.concatenate([p[0][k] for p in parts]) for k in range(len(cols))], np.concatenate([p[1] for p in parts])


def _packed(cols: list[np.ndarray], n: np.ndarray, words: list[str], buckets: int, common: int = 0) -> pa.RecordBatch:
    """A row for each bucket that gets records. Numbers up to ``common`` stay; those above count through the row's word list."""
    name = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    name[0] = 0
    mixed = np.zeros(len(n), np.uint64)
    for c in cols[:3]:
        mixed = (mixed ^ name[c]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    to = (mixed % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cols = [c[order] for c in cols]
    n = n[order]
    cut = np.append(np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else [], len(to)).astype(np.int64)
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        cells = np.stack([*(c[a:b] for c in cols), n[a:b]]).astype(np.int32)
        listed = cells[:-1] > common
        used, local = np.unique(cells[:-1][listed], return_inverse=True)
        cells[:-1][listed] = local + common + 1
        text = "\n".join([words[k] for k in used]).encode()
        cells[0, 1:] -= cells[0, :-1].copy()
        planes = cells.view(np.uint8).reshape(len(cols) + 1, b - a, 4).transpose(0, 2, 1)
        rows.append((int(to[a]), int(b - a), len(text), pa.compress(text, "zstd", asbytes=True), pa.compress(planes.tobytes(), "zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, _SCHEMA.types)], schema=_SCHEMA)


def _unpacked(rows: int, width: int, list_size: int, words: bytes, cells: bytes) -> tuple[list[str], np.ndarray]:
    """listed words, and a matrix of the record's numbers and, in its last row, how often it came."""
    planes = np.frombuffer(pa.decompress(cells, (width + 1) * rows * 4, "zstd", asbytes=True), np.uint8).reshape(width + 1, 4, rows)
    got = planes.transpose(0, 2, 1).copy(order="C").view(np.int32).reshape(width + 1, rows)
    got[0] = np.cumsum(got[0])
    return pa.decompress(words, list_size, "zstd", asbytes=True).decode().split("\n") if list_size else [], got


def _windows(ids: np.ndarray, longest: int, upto: int) -> list[np.ndarray]:
    """Of each place before ``upto``: its number and those of the places after it, 0 from the sentence's end on."""
    padded = np.concatenate([ids, np.zeros(longest, np.int32)])
    cols = [padded[:upto]]
    for k in range(1, longest):
        cols.append(np.where(cols[-1] != 0, padded[k : k + upto], 0))
    return [c[cols[0] != 0] for c in cols]


def ngram_columns(longest: int) -> tuple[int, Callable]:
    """(tokens that count after a place, columns of a chunk) of all runs of 1 to ``longest`` words."""
    return longest - 1, lambda ids, upto, numbers: _windows(ids, longest, upto)


def after_columns(classes: list[str], longest: int) -> tuple[int, Callable]:
    """The same of a class, as one word, and 1 to ``longest`` words right after it."""
    split = [(c, c.split(" ")) for c in classes]
    most = max((len(t) for _, t in split), default=0)

    def columns(ids: np.ndarray, upto: int, numbers: _Numbers) -> list[np.ndarray]:
        parts = [[np.zeros(0, np.int32)] * (longest + 1)]
        wide = np.concatenate([ids, np.zeros(most + longest, np.int32)])
        for name, tokens in split:
            if not all(t in numbers for t in tokens):
                continue
            own = [numbers[t] for t in tokens]
            at = np.flatnonzero(wide[:upto] == own[0])
            for k, number in enumerate(own[1:], 1):
                at = at[wide[at + k] == number]
            cols = [np.full(len(at), numbers[name], np.int32)]
            for k in range(longest):
                cols.append(np.where(cols[-1] != 0, wide[at + len(own) + k], 0).astype(np.int32))
            parts.append(cols)
        return [np.concatenate([p[k] for p in parts]) for k in range(longest + 1)]

    return max(most + longest - 1, 0), columns


def _sender(ahead: int, columns: Callable, buckets: int, common: Sequence[str] = ()) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids = _Numbers(common), array("i")
        most_words = CHUNK_WORDS + len(common)

        def flush(last: bool) -> pa.RecordBatch:
            """Records of the places whose following tokens are all here; the others stay for the next chunk."""
            nonlocal numbers, ids
            upto = len(ids) if last else max(len(ids) - ahead, 0)
            every = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
            made = _packed(*_records(columns(every, upto, numbers)), numbers.words, buckets, len(common))
            kept, words = every[upto:].tolist(), numbers.words
            numbers, ids = _Numbers(common), array("i")
            ids.extend(numbers[words[k]] if k else 0 for k in kept)
            return made

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                if len(text) < LONG_CHARS:
                    ids.extend(map(numbers.__getitem__, _TOKEN.findall(text)))
                else:
                    for m in _TOKEN.finditer(text):
                        ids.append(numbers[m.group()])
                        if len(ids) >= CHUNK_TOKENS or len(numbers) >= most_words:
                            yield flush(False)
                ids.append(0)
                if len(ids) >= CHUNK_TOKENS or len(numbers) >= most_words:
                    yield flush(False)
        yield flush(True)

    return send


def _receiver(width: int, least: int, common: Sequence[str] = ()) -> Callable:
    def receive(table: pa.Table) -> pa.Table:
        numbers, own = _Numbers(), np.zeros(len(common) + 1, np.int32)  # own: this bucket's numbers of the common words it has
        held, counts, waiting = [np.zeros((width, 0), np.int32)], [np.zeros(0, np.int64)], 0

        def merge() -> tuple[list[np.ndarray], np.ndarray]:
            cols, n = np.concatenate(held, axis=1), np.concatenate(counts)
            held.clear()
            counts.clear()
            return _distinct(list(cols), n)

        for k in range(table.num_rows):
            row = [table.column(c)[k].as_py() for c in ("rows", "list_size", "words", "cells")]
            words, got = _unpacked(row[0], width, *row[1:])
            there = np.zeros(len(common) + 1 + len(words), bool)
            there[got[:width]] = True
            new = np.flatnonzero(there[1 : len(common) + 1] & (own[1:] == 0))
            own[new + 1] = [numbers[common[x]] for x in new.tolist()]
            here = np.concatenate([own, np.fromiter((numbers[w] for w in words), np.int32, len(words))])
            held.append(here[got[:width]])
            counts.append(got[width].astype(np.int64))
            waiting += row[0]
            if waiting >= MERGE_RECORDS:
                cols, n = merge()
                held.append(np.stack(cols))
                counts.append(n)
                waiting = 0
        cols, n = merge()
        names, lengths, freqs = [], [], []
        short = cols[2] == 0 if width > 2 else np.ones(len(n), bool)
        for length in range(1, width + 1):
            if length < 3:
                at = np.flatnonzero(short & (cols[length - 1] != 0) & ((cols[length] == 0) if length < width else True))
                first, total = at, n[at]
            else:
                at = np.flatnonzero(cols[length - 1] != 0)
                new = np.zeros(len(at), bool)
                new[:1] = True
                for c in cols[:length]:
                    new[1:] |= c[at[1:]] != c[at[:-1]]
                begin = np.flatnonzero(new)
                first, total = at[begin], np.add.reduceat(n[at], begin) if len(begin) else n[:0]
            often = total >= least
            first = first[often]
            freqs.append(total[often])
            lengths.append(np.full(len(first), length, np.int32))
            names.extend(zip(*([numbers.words[x] for x in c[first].tolist()] for c in cols[:length])))
        head, tail = [x[0] for x in names], [" ".join(x[1:]) for x in names]
        return pa.table([pa.array(head, pa.string()), pa.array(tail, pa.string()), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(freqs))], ["head", "tail", "n_tokens", "freq"])

    return receive


def _common(texts: DataFrame, chars: int) -> list[str]:
    """Words that come more than once in the beginnings of some texts, the most frequent first."""
    some = texts.sample(min(1.0, COMMON_CHARS / max(chars, 1)), 1).select(F.explode(F.split(F.lower(F.substring("text", 1, BEGINNING)), "[^a-z0-9]+")).alias("word"))
    often = some.where(F.length("word").between(1, COMMON_LENGTH)).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return [r.word for r in often.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()]


def counted_runs(texts: DataFrame, ahead: int, columns: Callable, width: int, least: int) -> DataFrame:
    """(head, tail, n_tokens, freq) of texts(text): the first word and the others of each run that comes ``least`` times."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    common = _common(texts, chars)
    packed = texts.select(F.lower("text").alias("text")).mapInArrow(_sender(ahead, columns, 1 + chars // BUCKET_CHARS, common), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_receiver(width, least, common), "head string, tail string, n_tokens int, freq long")
