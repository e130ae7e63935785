"""Tables for reading by eye: schemas, scores and match decisions, as DataFrames to show or print."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Layers in the order in which they are shown.
LAYERS = (
    "classes", "taxonomy", "attributes_effective_micro", "attributes_effective_macro", "attributes_declared_micro", "attributes_declared_macro", "relations", "relations_allow_inverse",
)


def schema_view(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """(run, kind, line): a line for each class, "name (parent): attributes", and each relation, "source --label-> target"."""
    c = F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" ("), "parent", F.lit(")")), F.lit("")), F.lit(": "), F.when(F.size("attributes") > 0, F.array_join("attributes", ", ")).otherwise("-"))
    r = F.concat("source", F.lit(" --"), "label", F.lit("-> "), "target")
    return classes.select("run", F.lit("class").alias("kind"), c.alias("line")).union(relations.select("run", F.lit("relation").alias("kind"), r.alias("line"))).orderBy("run", "kind", "line")


def score_view(scores: DataFrame, levels: tuple[str, ...] = ("M1", "M2", "M3")) -> DataFrame:
    """A row for each run and layer, a column for each level: "F1 (tp/fp/fn)", n/a where there is no score."""
    cell = F.concat(F.format_number("f1", 3), F.lit(" ("), F.concat_ws("/", *(F.col(c).cast("string") for c in ("tp", "fp", "fn"))), F.lit(")"))
    wide = scores.withColumn("cell", F.coalesce(cell, F.lit("n/a"))).groupBy("run", "layer").pivot("level", list(levels)).agg(F.first("cell"))
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    return wide.select("run", "layer", *(F.coalesce(lv, F.lit("n/a")).alias(lv) for lv in levels)).orderBy("run", place)


def match_view(decisions: DataFrame) -> DataFrame:
    """A line for each matched class: run, level, gold, induced and the score with three places."""
    return decisions.select("run", "level", "gold", "induced", F.format_number("score", 3).alias("score")).orderBy("run", "level", "gold")
