"""Schemas made from a gold schema by one known fault, for testing a scorer.

Each takes (classes, relations) of a gold schema and returns those of an induced one; ``as_run`` gives them a run's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Schema = tuple[DataFrame, DataFrame]


def as_run(schema: Schema, run: str) -> Schema:
    classes, relations = schema
    return classes.select(F.lit(run).alias("run"), "name", "parent", "attributes"), relations.select(F.lit(run).alias("run"), "source", "label", "target")


def identity(gold: Schema) -> Schema:
    return gold


def _renamed(column: str, names: dict[str, str]) -> Column:
    if not names:
        return F.col(column)
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(mapped, F.col(column)), F.col(column)).alias(column)


def rename(gold: Schema, names: dict[str, str]) -> Schema:
    """Classes under other names, everywhere."""
    classes, relations = gold
    return classes.select(_renamed("name", names), _renamed("parent", names), "attributes"), relations.select(_renamed("source", names), "label", _renamed("target", names))


def add_classes(gold: Schema, names: list[str]) -> Schema:
    """With more classes, which have nothing."""
    classes, relations = gold
    more = classes.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return classes.unionByName(more.select("name", F.lit(None).cast("string").alias("parent"), F.array().cast(classes.schema["attributes"].dataType).alias("attributes"))), relations


def keep_half(gold: Schema) -> Schema:
    """The first half of the classes by name, rounded down, and the relations between them."""
    classes, relations = gold
    kept = classes.orderBy("name").limit(classes.count() // 2)
    names = kept.select("name")
    inside = relations.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    return kept, inside.select("source", "label", "target")


def flatten(gold: Schema) -> Schema:
    """Without parents."""
    classes, relations = gold
    return classes.withColumn("parent", F.lit(None).cast("string")), relations


def split(gold: Schema, name: str, into: list[str]) -> Schema:
    """One class as several, each with its parent and attributes; relations stay as they are."""
    classes, relations = gold
    parts = classes.where(F.col("name") == name).select(F.explode(F.array(*map(F.lit, into))).alias("name"), "parent", "attributes")
    return classes.where(F.col("name") != name).unionByName(parts), relations


def reverse(gold: Schema) -> Schema:
    """Every relation with its ends exchanged."""
    classes, relations = gold
    return classes, relations.select(F.col("target").alias("source"), "label", F.col("source").alias("target"))


def relabel(gold: Schema, labels: dict[tuple[str, str], str]) -> Schema:
    """Relations with other labels, by (label, target)."""
    classes, relations = gold
    new = F.col("label")
    for (label, target), other in labels.items():
        new = F.when((F.col("label") == label) & (F.col("target") == target), other).otherwise(new)
    return classes, relations.select("source", new.alias("label"), "target")


def ordered(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row (classes, relations) of a schema whose rows have a pos, in its order."""
    c = classes.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "parent", "attributes"))), lambda x: F.struct(x["name"], x["parent"], x["attributes"])).alias("classes"))
    r = relations.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source", "label", "target"))), lambda x: F.struct(x["source"], x["label"], x["target"])).alias("relations"))
    return c.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one").select("classes", "relations")


def to_contract(schema: Schema, condition: str) -> DataFrame:
    """(schema_json) of a schema without a run, as induced schemas are exchanged."""
    classes, relations = schema
    c = classes.agg(F.array_sort(F.collect_list(F.struct("name", "parent", F.array_sort("attributes").alias("attributes")))).alias("classes"))
    r = relations.agg(F.array_sort(F.collect_list(F.struct("source", "label", "target"))).alias("relations"))
    meta = F.struct(F.lit(condition).alias("condition"), F.lit("toy-fixture").alias("model"), F.lit(f"toy-{condition}").alias("run_id"), F.array().cast("array<string>").alias("source_documents"))
    both = c.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct("classes", "relations", meta.alias("metadata")), {"ignoreNullFields": "false"}).alias("schema_json"))
