"""Best-fit packing under conflicts.

Texts are cut into pieces of at most ``CAPACITY`` words and packed into bins. Open bins are ordered by
residual room; each carries a bitmap of its sources (in layers, up to ``SOURCE_QUOTA`` pieces of one source)
and a bitmap of its duplicate clusters (one piece of each). A piece goes to the tightest bin with room; while
that bin conflicts the successor search goes on to the next larger one; without any a new bin opens.

Packing is local to shards: rows are dealt by a hash of their id into shards of about ``SHARD_WORDS`` words,
so a hot source or cluster, or a row that repeats, is spread over all shards and no task grows with the input. Only ids,
sources, lengths and a hash of the text are shuffled.

Null texts and texts without words give no piece; a text longer than ``CAPACITY`` gives several, which are packed apart.
Repeated rows are pieces of their own and of one cluster. Null ids are kept and come last among pieces of a size; ids may
be numbers or strings. An empty table gives no rows. Of the table's other columns only ``cluster`` is read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from schemaloom.llm.common import map_rows, materialise, table

CAPACITY, SOURCE_QUOTA, SHARD_WORDS = 2048, 4, 1_000_000


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA):
        self.capacity, self.quota = capacity, quota
        self.open: list[tuple[int, int]] = []  # (room, bin), ordered
        self.sources: list[list[int]] = []  # by bin: bitmap layers, the k-th of sources with more than k pieces
        self.clusters: list[int] = []
        self.count: list[int] = []
        self.bits: dict = {}

    def bit(self, key) -> int:
        return 1 << self.bits.setdefault(key, len(self.bits))

    def place(self, size: int, source, cluster) -> tuple[int, int, int]:
        """(bin, position in it, first word of its room)."""
        s, c = self.bit(("s", source)), self.bit(("c", cluster)) if cluster is not None else 0
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            room, b = self.open[at]
            if not self.sources[b][-1] & s and not self.clusters[b] & c:
                del self.open[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.clusters)
            self.sources.append([0] * self.quota)
            self.clusters.append(0)
            self.count.append(0)
        layers = self.sources[b]
        layers[next(k for k in range(self.quota) if not layers[k] & s)] |= s
        self.clusters[b] |= c
        self.count[b] += 1
        if room > size:
            insort(self.open, (room - size, b))
        return b, self.count[b] - 1, self.capacity - room


def pack(docs: DataFrame, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, piece, first_word, n_words, shard, bin, position, offset): every word of every text, once.

    docs(doc_id, text, source and, if it has one, cluster); without a cluster column equal texts are one
    cluster. Pieces are placed largest first, ties by id, place and text. A null source is a source of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    has = "cluster" in docs.columns
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), (F.col("cluster").cast("string") if has else F.lit(None).cast("string")).alias("cluster"))

    def make():
        def row(i, text, source, cluster):
            text = text or b""
            key = cluster if cluster is not None else text
            return i, None if source is None else source.decode(), xxhash.xxh3_64_intdigest(key) - (1 << 63), len(text.split())

        return row

    sized = materialise(map_rows(rows, make, f"doc_id {kind}, source string, cluster long, n long"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    dealt = sized.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != shard and held:
                    yield placed(shard, held)
                    held = []
                shard = r[0]
                held.append(r[1:])
        if held:
            yield placed(shard, held)

    def placed(shard, rows) -> pa.RecordBatch:
        pieces = [(min(capacity, n - a), i, k, a, source, cluster) for i, source, cluster, n in rows for k, a in enumerate(range(0, n, capacity))]
        pieces.sort(key=lambda p: (-p[0], p[1] is None, 0 if p[1] is None else p[1], p[2], p[5]))
        packer, out = Packer(capacity, quota), []
        for size, i, k, a, source, cluster in pieces:
            out.append((i, k, a, size, shard, *packer.place(size, source, cluster)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "piece", "first_word", "n_words", "shard", "bin", "position", "offset"]
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])).schema
    types = to_arrow_schema(out).types
    return dealt.select("shard", "doc_id", "source", "cluster", "n").mapInArrow(run, out)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
