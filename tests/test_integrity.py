from collections import Counter

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import integrity as G


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_ROWS", 1000, raising=False)
    child, parent = spark.range(30_000).toDF("k"), spark.range(0, 30_000, 30_000).toDF("id")
    lost = G.missing_keys(child, "k", parent, "id", "r")
    assert lost.count() == 29_999
    assert lost.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    twice = G.duplicate_keys(child.union(child), "k", "r")
    assert twice.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()[:] < (2000, 30_001)


def test_rows_of_a_frequent_key_are_sent_together(spark):
    child = spark.range(50_000).select(F.when(F.col("id") < 5, F.col("id")).otherwise(-7).alias("k")).union(spark.createDataFrame([(None,), (None,)], "k long"))
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    got = Counter(map(tuple, G.missing_keys(child, "k", parent, "id", "r").collect()))
    assert got == {("r", "-7"): 49_995, ("r", "0"): 1, ("r", "3"): 1, ("r", "4"): 1}
    assert sorted(map(tuple, G.duplicate_keys(child, "k", "r").collect()), key=str) == [("r", "-7"), ("r", None)]
    assert G._counts(child, "k").count() < 50


@pytest.mark.parametrize("kind,values", [("string", ["a", "b", "b", "", None]), ("double", [1.5, 2.0, 2.0, None]), ("int", [1, 2, 2, None]), ("boolean", [True, False, False, None])])
def test_keys_of_any_kind(spark, kind, values):
    child = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    parent = spark.createDataFrame([(values[0],)], f"id {kind}")
    text = lambda v: one if (one := str(v)) not in ("True", "False") else one.lower()
    assert Counter(r.key for r in G.missing_keys(child, "k", parent, "id", "r").collect()) == Counter(text(v) for v in values[1:] if v is not None)
    assert [r.key for r in G.duplicate_keys(child, "k", "r").collect()] == [text(values[1])]
