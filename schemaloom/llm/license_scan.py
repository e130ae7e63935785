"""License scans: fuzzy search for short notices.

A notice of length m with at most k edits is split into k+1 pieces; by the pigeonhole principle any
occurrence within k edits holds one piece unchanged. Exact search for the pieces gives candidate
spans, and the ``regex`` library's bounded-error matching verifies each one and reports its edits.
One pass over the table, no shuffle.

Null and empty texts have no words, a score of 0 and null places; every row, repeated ones and those with a null id too,
gives one row, and an empty table none. Texts are searched whole, in time that grows with their length. Labels are sorted,
so ties have no order to choose; of several notices with one label each is reported. Other columns of the table, whatever
their names, aren't read.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from schemaloom.llm.common import map_rows, table

# Phrases whose exact places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices searched with up to the given number of edits, and a word that has to stand unchanged (or none).
NOTICES = (
    ("general public license", "gpl", 3, ""),
    ("all rights reserved", "reserved", 2, ""),
    ("licensed under cc by", "cc-by", 2, "cc"),
    ("creative commons attribution", "cc-by", 3, ""),
    ("the mit license", "mit", 2, "mit"),
    ("permission is hereby granted free of charge", "mit", 4, ""),
    ("the apache license", "apache", 2, ""),
    ("redistribution and use in source and binary forms", "bsd", 4, ""),
    ("mozilla public license", "mpl", 3, ""),
    ("dedicated to the public domain", "public-domain", 3, ""),
)

# Bytes kept in words, A-Z lower-cased; every other ASCII byte separates words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(phrase: bytes, k: int) -> list[tuple[int, bytes]]:
    """k+1 adjoining pieces of nearly equal length, each with its offset."""
    cut = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:])]


class Scanner:
    """Finds notices in one text at a time; built once per task."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base]
        self.notices = []
        for phrase, label, k, core in notices:
            p = phrase.encode()
            verify = regex.compile(rb"(?e)(?<= )(?:" + regex.escape(p, literal_spaces=True) + rb"){e<=%d}(?= )" % k)
            self.notices.append((label, k, len(p), pieces(p, k), verify, b" %s " % core.encode() if core else b""))

    def __call__(self, text: bytes | None):
        words = (text or b"").translate(_FOLD).split()
        canon = b" " + b" ".join(words) + b" "
        places, base_labels = [], set()
        for needle, label in self.base:
            at, place, counted = canon.find(needle), 0, 0
            while at >= 0:
                place, counted = place + canon.count(b" ", counted, at), at
                places.append(place)
                base_labels.add(label)
                at = canon.find(needle, at + 1)
        spans = [s for n in self.notices for s in self._fuzzy(canon, *n)]
        score = max([1.0 if base_labels else 0.0, *(1 - s["edits"] / s["length"] for s in spans)])
        for s in spans:
            del s["length"]
        labels = base_labels | {s["label"] for s in spans}
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans

    @staticmethod
    def _fuzzy(canon: bytes, label: str, k: int, length: int, seeds, verify, core: bytes):
        windows = []
        for offset, seed in seeds:
            at = canon.find(seed)
            while at >= 0:
                windows.append((max(0, at - offset - k - 1), at - offset + length + k + 1))
                at = canon.find(seed, at + 1)
        if not windows:
            return
        windows.sort()
        merged = [windows[0]]
        for a, b in windows[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spaces = counted = 0
        for a, b in merged:
            for m in verify.finditer(canon, a, b):
                if core not in b" %s " % m.group():
                    continue
                spaces, counted = spaces + canon.count(b" ", counted, m.start()), m.start()
                first = spaces - 1
                yield {"label": label, "first_word": first, "last_word": first + m.group().count(b" "), "edits": sum(m.fuzzy_counts), "length": length}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """id, word count, exact places, labels, score and the verified spans (word positions, edits).

    score is 1 for an exact base phrase, else 1 - edits/length of the best notice, 0 without any.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        scanner = Scanner(base, notices)
        return lambda i, text: (i, *scanner(text))

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"`{id_col}` {kind}, {SCHEMA}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op1_license_scan": op1_license_scan}
