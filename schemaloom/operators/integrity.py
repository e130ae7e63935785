"""Referential integrity and outcome counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows that one task of a join or count of keys gets on the average. The number of tasks is fixed by it: keys in order
#: compress so well that partitions sized by their bytes would hold more and more of them.
TASK_ROWS = 500_000


def _tasks(*frames: DataFrame) -> int:
    return 1 + sum(df.count() for df in frames) // TASK_ROWS


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by("key").aggregate([([], "count_all")])
        yield from pa.table([counted["key"], counted["count_all"]], ["key", "n"]).to_batches()


def _counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys counted in each batch where it lies, so that the rows of a frequent key don't go to one task."""
    kind = StructType([StructField("key", df.schema[key].dataType), StructField("n", LongType())])
    return df.select(F.col(key).alias("key")).mapInArrow(_batch_counts, kind)


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, key): child rows whose non-null key has no parent."""
    tasks = _tasks(child, parent)
    ids = parent.select(F.col(parent_key).alias("key")).repartition(tasks, "key")
    lost = _counts(child.where(F.col(key).isNotNull()), key).repartition(tasks, "key").join(ids, "key", "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def duplicate_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    counted = _counts(df, key).repartition(_tasks(df), "key").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select(F.lit(rule).alias("rule"), F.col("key").cast("string").alias("key"))


def outcome_counts(events: DataFrame, kind: str, outcome: str, values: list[str]) -> DataFrame:
    """One row per kind with a count for each outcome, and the total."""
    wide = events.groupBy(kind).pivot(outcome, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))
