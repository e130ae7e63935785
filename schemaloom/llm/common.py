"""Shared helpers: table access, lineage cuts, Arrow row mapping and word hashing.

Nothing here collects data to the driver. Lineage is cut by writing Parquet into the folder
named by ``spark.checkpoint.dir``, which every executor shares.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from schemaloom.sources.tables import shared_dir

#: Word hashes remembered per Python worker; the memo is emptied when full, so memory is bounded.
MEMO_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe against lost executors.

    ``by``: a column with few values, each written to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that ``spread_join`` sends by broadcast at most.
HOT_KEYS = 1000


def spread_join(big: DataFrame, small: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``big`` joined with small(*key, n, ...), one row for each key, n being the rows of ``big`` that have it.

    Keys that hold more than a share of 1 / ``HOT_KEYS`` of all ``total`` rows, fewer than ``HOT_KEYS`` whatever the
    input, are broadcast, so their rows stay where they are; of the others none has more than that share. ``small`` is
    read twice, so it should be a written table."""
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(small.where(F.col("n") * HOT_KEYS > total))
    light = small.where(F.col("n") * HOT_KEYS <= total)
    rest = big.join(hot.select(*keys), keys, "left_anti")
    return big.join(hot, keys).drop("n").unionByName(rest.join(light.hint("shuffle_hash"), keys).drop("n"))


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these, once nothing reads it any more."""
    spark = frames[0].sparkSession
    home = shared_dir(spark)
    plain = lambda x: re.sub(r"^file:/+", "/", x)
    files = [plain(f) for df in frames for f in df.inputFiles()]
    for path in {m[0] for f in files if (m := re.match(re.escape(plain(home)) + r"/[0-9a-f]{32}(?=/)", f))}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home + path[len(plain(home)) :])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows handled at a time in a Python worker, whatever the size of the batches that come.
SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``SLICE`` rows, so that a worker holds the Python objects and results of few."""
    for b in batches:
        for a in range(0, b.num_rows, SLICE):
            yield b.slice(a, SLICE)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str | StructType) -> DataFrame:
    """One output row per input row. ``make()`` runs once per task and returns a function that takes
    the row's values (strings as UTF-8 bytes, null as None) and returns a tuple in ``schema`` order."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in slices(batches):
            cols = [as_bytes(c).to_pylist() for c in batch.columns]
            made = list(map(row, *cols))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def as_bytes(column: pa.Array) -> pa.Array:
    """String columns as binary, so that Python handles UTF-8 bytes without decoding."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary())
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary())
    return column


class WordHashes(dict):
    """word -> 64-bit hash with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over 64-bit values, element by element."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc *= _M1
        acc += words[k : n + k]
    return mix(acc)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean per word: inside a window of ``width`` words that starts at one of ``starts``."""
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0
