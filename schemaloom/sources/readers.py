"""Sources and sinks: Turtle ontologies, schema JSON, document folders, CSV rows, long score tables."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from schemaloom.functions.text import local_name, normalize
from schemaloom.operators.match import M2_THRESHOLD, M3_THRESHOLD, Pack, embed, hashed_ngrams
from schemaloom.operators.terms import sentences
from schemaloom.sources.tables import append_new, exists, written

_TOKEN = re.compile(r'<[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*|@[a-zA-Z][\w-]*|\^\^|[;,.](?=\s|$)|[\[\]()]|[^\s;,<>"\[\]()]+?(?=[;,]|\.?(?:\s|$))', re.S)
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TRIPLE = "ord long, s string, p string, o string"


def turtle_triples(text: str) -> list[tuple[int, str, str, str]]:
    """Triples of the Turtle subset with prefixes, a, ; and , lists, IRIs, literals and comments."""
    prefixes: dict[str, str] = {}
    words = [t for t in _TOKEN.findall(text) if not t.startswith("#")]

    def name(t: str) -> str:
        if t[0] == "<":
            return t[1:-1]
        if t[0] == '"':
            return t.strip('"')
        if t == "a":
            return RDF + "type"
        prefix, colon, rest = t.partition(":")
        return prefixes.get(prefix, prefix + ":") + rest if colon else t

    out, part, subject, verb = [], [], None, None
    i = 0
    while i < len(words):
        t = words[i]
        if t.lower() in ("@prefix", "prefix"):
            prefixes[words[i + 1].rstrip(":")] = words[i + 2][1:-1]
            i += 4 if i + 3 < len(words) and words[i + 3] == "." else 3
            continue
        if t == "^^":
            i += 2
            continue
        if t in ".;,":
            if part:
                *head, value = part
                if len(head) == 2:
                    subject, verb = head
                elif len(head) == 1:
                    verb = head[0]
                out.append((len(out), subject, verb, value))
            part = []
            if t == ".":
                subject = verb = None
        elif not (t[0] == "@" and part):
            part.append(name(t))
        i += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, s, p, o) of every Turtle file; one file is one row of text."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for b in batches:
            rows = [(f, *t) for f, v in zip(b["file"], b["value"]) for t in turtle_triples(v)]
            yield pd.DataFrame(rows, columns=["file", "ord", "s", "p", "o"])

    return texts.mapInPandas(run, f"file string, {TRIPLE}")


def gold_schema(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, relations) of an ontology's triples.

    A class takes its first parent and the datatype properties of its domain; properties without a domain are dropped.
    A sub-property gives a relation under its parent's name, and the generic parent is left out."""
    t = triples.select("ord", local_name(F.col("s")).alias("s"), "p", local_name(F.col("o")).alias("o"))
    of = lambda p, c: t.where(F.col("p") == p).groupBy("s").agg(F.min_by("o", "ord").alias(c))
    typed = lambda kind: t.where((F.col("p") == RDF + "type") & (F.col("o") == kind)).select("s").distinct()
    domain, range_, parent, above = of(RDFS + "domain", "domain"), of(RDFS + "range", "range"), of(RDFS + "subClassOf", "parent"), of(RDFS + "subPropertyOf", "above")
    attrs = typed("DatatypeProperty").join(domain, "s").groupBy("domain").agg(F.array_sort(F.collect_set("s")).alias("attributes"))
    classes = typed("Class").join(parent, "s", "left").join(attrs, F.col("s") == F.col("domain"), "left").select(F.col("s").alias("name"), "parent", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))
    props = typed("ObjectProperty").join(above, "s", "left")
    generic = props.where("above is not null").select(F.col("above").alias("s")).distinct()
    made = props.join(generic, "s", "left_anti").join(domain, "s").join(range_, "s")
    return classes, made.select(F.col("domain").alias("source"), F.coalesce("above", "s").alias("label"), F.col("range").alias("target")).distinct()


CONTRACT = "classes array<struct<name:string,parent:string,attributes:array<string>>>, relations array<struct<source:string,label:string,target:string>>, metadata struct<condition:string,model:string,run_id:string,source_documents:array<string>,stop_reason:string,completion_tokens:bigint>"


def read_induced(spark: SparkSession, path: str) -> DataFrame:
    """(run, classes, relations, metadata) of schema JSON files; missing lists are empty, a missing run id is the file's stem."""
    raw = spark.read.json(path, schema=CONTRACT, multiLine=True).withColumn("file", F.input_file_name())
    run = F.coalesce("metadata.run_id", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return raw.select(run.alias("run"), F.coalesce("classes", F.array().cast(raw.schema["classes"].dataType)).alias("classes"), F.coalesce("relations", F.array().cast(raw.schema["relations"].dataType)).alias("relations"), "metadata")


def read_documents(spark: SparkSession, root: str, folders: list[str], limit: int | None = None, filter_first: bool = True) -> DataFrame:
    """(ord, subdir, path, text) of .txt and .csv files, one of each folder in turn. ``filter_first``: other suffixes go
    before the limit per folder applies (else after it). Files are ordered by path and numbered without their texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = files.select("path").withColumn("subdir", F.element_at(F.split("path", "/"), -2)).where(F.col("subdir").isin(folders))
    wanted = F.col("path").rlike(r"\.(txt|csv)$")
    names = names.where(wanted) if filter_first else names
    names = interleave(names.withColumn("rank", F.array_position(F.array(*map(F.lit, folders)), F.col("subdir"))), "subdir", "path", "rank", limit)
    names = names.where(wanted)
    texts = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return names.select("ord", "subdir", "path").join(texts, "path").select("ord", "subdir", "path", "text")


def interleave(rows: DataFrame, group: str, key: str, rank: str, limit: int | None = None) -> DataFrame:
    """rows with round and ord: one row of each group per round by key, groups in the order of rank; the first ``limit``
    of each group. The place of a row is counted, not sorted: how many rows of each group come before it. So no task
    holds more than a group's keys."""
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    rows = rows.where(F.col("round") <= limit) if limit else rows
    sizes = rows.groupBy(F.col(rank).alias("_rank")).agg(F.count("*").alias("_size"))
    sizes = sizes.agg(F.collect_list(F.struct("_rank", "_size")).alias("_groups"))  # one entry for each group
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(sizes.withColumn("_one", F.lit(1))), "_one")
    before = F.expr(f"aggregate(_groups, 0L, (s, g) -> s + least(g._size, round - if(g._rank < `{rank}`, 0, 1)))")
    return rows.withColumn("ord", before).drop("_one", "_groups")


def csv_sentences(files: DataFrame) -> DataFrame:
    """files(path, text) -> (path, row_no, sentence): "column: value, column: value" per CSV row, blanks left out."""
    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                for k, r in enumerate(csv.DictReader(io.StringIO(text or ""))):
                    s = ", ".join(f"{c}: {v.strip()}" for c, v in r.items() if isinstance(v, str) and c and v.strip())
                    if s:
                        rows.append((path, k, s))
            yield pd.DataFrame(rows, columns=["path", "row_no", "sentence"])

    return files.select("path", "text").mapInPandas(run, "path string, row_no long, sentence string")


def corpus_sentences(spark: SparkSession, root: str, folders: list[str], limit: int | None = None) -> DataFrame:
    """(sent_id, path, sentence) of the .txt and .csv files of the folders, the first ``limit`` files of each (whatever their
    suffix): sentences of texts, a line for each row of a table. Written, so ids stay."""
    docs = written(read_documents(spark, root, folders, limit, filter_first=False))
    texts = sentences(docs.where(F.col("path").endswith(".txt")).select(F.col("path").alias("doc_id"), "text")).select(F.col("doc_id").alias("path"), F.col("sent_no").cast("long").alias("row_no"), "sentence")
    both = texts.union(csv_sentences(docs.where(F.col("path").endswith(".csv"))))
    return written(both.select(F.monotonically_increasing_id().alias("sent_id"), "path", "sentence"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(run, metadata) of schema JSON files: the other columns aren't read."""
    raw = spark.read.json(path, schema=CONTRACT, multiLine=True).select("metadata").withColumn("file", F.input_file_name())
    return raw.select(F.coalesce("metadata.run_id", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("run"), "metadata")


def schema_rows(induced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes(run, name, parent, attributes), relations(run, source, label, target)) of ``read_induced``. Of classes with
    one name the last definition counts; attributes and relations once each. A class without a name is an error."""
    c = induced.select("run", F.posexplode("classes").alias("pos", "c")).select("run", "pos", "c.*")
    name = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("a class without a name in run "), F.col("run")))).otherwise(F.col("name"))
    last = c.withColumn("name", name).groupBy("run", "name").agg(F.max_by(F.struct("parent", "attributes"), "pos").alias("x"))
    attributes = F.array_distinct(F.coalesce("x.attributes", F.array().cast("array<string>")))
    r = induced.select("run", F.explode("relations").alias("r")).select("run", "r.*").distinct()
    return last.select("run", "name", "x.parent", attributes.alias("attributes")), r


def read_pack(spark: SparkSession, path: str) -> Pack:
    """A domain pack from YAML: synonyms by key, stopwords, thresholds and the embedding model. Terms are normalised as
    names are. Synonyms of one key aren't synonyms of one another."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    words = [(k, s) for k, many in (raw.get("synonyms") or {}).items() for s in many]
    rows = spark.createDataFrame(words, "a string, b string").select(normalize(F.col("a")).alias("a"), normalize(F.col("b")).alias("b")).distinct()
    limits, model = raw.get("thresholds") or {}, raw.get("embedding") or {}
    return Pack(
        synonyms=tuple(sorted(tuple(r) for r in rows.collect())),  # as many as the file has
        stopwords=tuple(raw.get("stopwords") or ()),
        m2_threshold=float(limits.get("m2_token_set_ratio", M2_THRESHOLD)),
        m3_threshold=float(limits.get("m3_cosine_similarity", M3_THRESHOLD)),
        model_name=model.get("model_name") or Pack.model_name,
        model_version=model.get("model_version"),
        cache_path=model.get("cache_path"),
    )


CACHE = "model_name string, model_version string, norm string, vector array<double>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The embedding cache, empty where nothing is written yet."""
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def vectors_of(norms: DataFrame, path: str, encode=hashed_ngrams, model_name: str = Pack.model_name, model_version: str | None = None) -> DataFrame:
    """(norm, vector) of norms(norm): those the cache lacks are encoded once and appended to it, then all are read there."""
    spark = norms.sparkSession
    _, fresh = embed(norms, read_cache(spark, path), encode, model_name, model_version)
    fresh = written(fresh)
    if not fresh.isEmpty():
        append_new(fresh, path, ["model_name", "model_version", "norm"])
    return embed(norms, read_cache(spark, path), encode, model_name, model_version)[0]


def read_instances(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every *.json table of a folder by its stem; a file holds a list of records."""
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path").collect()]
    return {re.sub(r"^.*/|\.json$", "", f): spark.read.json(f, multiLine=True) for f in sorted(files)}


def latest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path last written of those that match, ties to the largest name."""
    if not exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def latest_run(spark: SparkSession, raw: str, tables: str, suffix: str) -> tuple[str | None, str | None, str | None]:
    """(run, schema path, scores path): the last schema named run + suffix, and the scores of that very run, if there are any."""
    path = latest(spark, raw, f"*{suffix}")
    if path is None:
        return None, None, None
    run = path.rsplit("/", 1)[-1][: -len(suffix)]
    scores = f"{tables}/{run}.csv"
    return run, path, scores if exists(spark, scores) else None


def write_scores(rows: DataFrame, path: str) -> None:
    """The long score table (run_id, model, condition, level, layer, metric, value) as CSV with a header, nulls as empty
    cells, in one file: it has 48 rows at most for each run and level."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_documents(documents: DataFrame, path: str) -> None:
    """documents(run, document) as JSON lines, a folder for each run."""
    documents.select("run", F.col("document").alias("value")).write.mode("overwrite").partitionBy("run").text(path)


def write_schema(schema: DataFrame, path: str) -> bool:
    """schema(schema_json) as text, only if it has a row: a run that failed leaves nothing. True if written."""
    if schema.isEmpty():
        return False
    schema.select(F.col("schema_json").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return True


def write_instances(tables: dict[str, DataFrame], violations: DataFrame, folder: str) -> None:
    """Each table as JSON lines in a folder of its name, only if there are no violations."""
    found = [tuple(r) for r in violations.limit(5).collect()]
    if found:
        raise ValueError(f"instances are not written; the first violations: {found}")
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
