"""Recovery, cleaning and consolidation of schemas that a model wrote, and prompts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from schemaloom.functions.text import name_key, strip_fences, strip_reasoning, usable

SCHEMA = "classes array<struct<name:string,parent:string,attributes:array<string>>>, relations array<struct<source:string,label:string,target:string>>"


def objects(text: str) -> Iterator[str]:
    """Balanced {...} of a text from left to right, outermost first; braces inside strings don't count."""
    opens: list[int] = []
    spans, quoted, escaped = [], False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and opens:
            quoted = True
        elif c == "{":
            opens.append(i)
        elif c == "}" and opens:
            spans.append((opens.pop(), i + 1))
    yield from (text[a:b] for a, b in sorted(spans))


def recover(text: str | None) -> tuple[str | None, str | None]:
    """(schema JSON, error): the whole text, else the first balanced object with classes or relations."""
    text = text or ""
    for piece in (text, *objects(text)):
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        if isinstance(found, dict) and ("classes" in found or "relations" in found):
            return json.dumps({k: found.get(k) if isinstance(found.get(k), list) else [] for k in ("classes", "relations")}), None
    return None, "no schema object in the response"


def parse_responses(raw: DataFrame) -> DataFrame:
    """raw(id, response) -> (id, schema_json, error); failures are rows, never empty schemas."""
    ready = raw.select("id", strip_fences(strip_reasoning(F.coalesce("response", F.lit("")))).alias("ready"))

    def run(batches):
        for b in batches:
            found = [recover(t) for t in b["ready"]]
            yield pd.DataFrame({"id": b["id"], "schema_json": [f[0] for f in found], "error": [f[1] for f in found]})

    return ready.mapInPandas(run, f"id {raw.schema['id'].dataType.simpleString()}, schema_json string, error string")


def clean_classes(rows: DataFrame) -> DataFrame:
    """rows(id, pos, name, parent, attributes) -> (id, name, parent, attributes): unusable names dropped, the first of a
    key wins, later ones only add attributes, attributes once each by key, order kept."""
    kept = rows.where(usable(F.col("name"))).withColumn("key", name_key(F.col("name")))
    heads = kept.groupBy("id", "key").agg(F.min_by(F.struct(F.trim("name").alias("name"), "parent"), "pos").alias("head"), F.min("pos").alias("pos"))
    attrs = kept.select("id", "key", "pos", F.posexplode("attributes").alias("at", "attr")).where(usable(F.col("attr")))
    attrs = attrs.groupBy("id", "key", name_key(F.col("attr")).alias("ak")).agg(F.min_by(F.struct("pos", "at", F.trim("attr").alias("attr")), F.struct("pos", "at")).alias("a"))
    attrs = attrs.groupBy("id", "key").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["attr"]).alias("attributes"))
    return heads.join(attrs, ["id", "key"], "left").select("id", "pos", F.col("head.name").alias("name"), F.col("head.parent").alias("parent"), F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))


def clean_relations(rows: DataFrame) -> DataFrame:
    """rows(id, pos, source, label, target): all three usable, the first of each key triple."""
    parts = ("source", "label", "target")
    kept = rows.where(usable(F.col("source")) & usable(F.col("label")) & usable(F.col("target")))
    first = kept.groupBy("id", *[name_key(F.col(p)).alias(f"k_{p}") for p in parts]).agg(F.min_by(F.struct(*[F.trim(p).alias(p) for p in parts]), "pos").alias("r"), F.min("pos").alias("pos"))
    return first.select("id", "pos", "r.*")


def explode_schema(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, relations) rows of parsed(id, schema_json)."""
    s = parsed.where("schema_json is not null").select("id", F.from_json("schema_json", SCHEMA).alias("s"))
    classes = s.select("id", F.posexplode("s.classes").alias("pos", "c")).select("id", "pos", "c.*")
    relations = s.select("id", F.posexplode("s.relations").alias("pos", "r")).select("id", "pos", "r.*")
    return classes, relations


def last_wins(rows: DataFrame) -> DataFrame:
    """rows(id, pos, name, ...): the last definition of a name, at the first one's place."""
    w = Window.partitionBy("id", "name")
    return rows.withColumn("first", F.min("pos").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("pos")))).where("rank = 1").withColumn("pos", F.col("first")).drop("first", "rank")


def render_prompts(docs: DataFrame, template: str, per_prompt: int, placeholder: str = "{documents}") -> DataFrame:
    """(batch, prompt, n_chars, est_tokens): consecutive batches of documents (ord, name, text) in a template."""
    if placeholder not in template:
        raise ValueError(f"the template has no {placeholder}")
    batch = docs.withColumn("batch", F.floor(F.col("ord") / per_prompt))
    one = F.concat(F.lit("### "), F.col("name"), F.lit("\n"), F.trim("text"))
    made = batch.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    made = made.select("batch", F.replace(F.lit(template), F.lit(placeholder), F.col("body")).alias("prompt"))
    return made.withColumn("n_chars", F.length("prompt")).withColumn("est_tokens", F.round(F.col("n_chars") / 3.5).cast("long"))


def consolidate(classes: DataFrame) -> DataFrame:
    """One class per key over all partial schemas: the most frequent wording, parents by majority, all attributes."""
    keyed = classes.withColumn("key", name_key(F.col("name")))
    most = lambda c: F.min_by(c, F.struct(-F.col("n"), F.col(c)))
    names = keyed.groupBy("key", "name").agg(F.count("*").alias("n")).groupBy("key").agg(most("name").alias("name"), F.sum("n").alias("support"))
    parents = keyed.where("parent is not null").groupBy("key", "parent").agg(F.count("*").alias("n")).groupBy("key").agg(most("parent").alias("parent"))
    attrs = keyed.select("key", F.explode("attributes").alias("attr")).groupBy("key").agg(F.array_sort(F.collect_set(name_key(F.col("attr")))).alias("attributes"))
    return names.join(parents, "key", "left").join(attrs, "key", "left").select("name", "parent", "support", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))
