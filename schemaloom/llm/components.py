"""Connected components of an edge table by alternating large-star and small-star rounds.

Both stars are an aggregation plus an equi-join, so hubs are pre-aggregated before the shuffle and
AQE may split a skewed join key; no component is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from schemaloom.llm.common import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a bigint, b bigint) -> (node, component): the smallest node reachable, for nodes with links.

    Null ends and self links are ignored; repeated edges are harmless; an empty table gives none.
    """
    cur = materialise(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _mark(cur)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = materialise(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    node = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.union(node.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Order-free signature of an edge set: two numbers, whatever its size."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
