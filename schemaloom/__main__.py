"""Command line: score schemas against a gold ontology, induce one from documents, show what was made.

    python -m schemaloom score --gold g.ttl --induced 'runs/*.json' --out scores [--pack p.yaml] [--level all] [--allow-inverse] [--masked] [--cache vectors]
    python -m schemaloom induce --documents folder --folders csv notes --out schema [--limit 10] [--classes 20]
    python -m schemaloom show --induced 'runs/*.json' | --scores scores/table
    python -m schemaloom instances --out folder [--seed 42]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from schemaloom.operators import annotate, fixtures, instances, match, model_runs, score, terms, views
from schemaloom.sources import readers
from schemaloom.sources.tables import written

LEVELS = ("M1", "M2", "M3")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="schemaloom")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("score")
    for flag in ("--gold", "--induced", "--out"):
        s.add_argument(flag, required=True)
    s.add_argument("--pack")
    s.add_argument("--cache", help="table of vectors; without it M3 uses hashed n-grams and keeps none")
    s.add_argument("--level", default="all", choices=("all", *LEVELS))
    s.add_argument("--allow-inverse", action="store_true")
    s.add_argument("--masked", action="store_true")
    i = sub.add_parser("induce")
    i.add_argument("--documents", required=True)
    i.add_argument("--folders", nargs="+", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--limit", type=int)
    i.add_argument("--classes", type=int, default=terms.TOP_CLASSES)
    w = sub.add_parser("show")
    w.add_argument("--induced")
    w.add_argument("--scores")
    n = sub.add_parser("instances")
    n.add_argument("--out", required=True)
    n.add_argument("--seed", type=int, default=42)
    return p


def _score(spark: SparkSession, a) -> None:
    gold = tuple(map(written, readers.gold_schema(readers.read_turtle(spark, a.gold))))
    found = written(readers.read_induced(spark, a.induced))
    induced, runs = tuple(map(written, readers.schema_rows(found))), found.select("run").distinct()
    pack = readers.read_pack(spark, a.pack) if a.pack else match.Pack()
    levels, vectors = LEVELS if a.level == "all" else (a.level,), None
    if "M3" in levels:
        norms = score.names_of(*gold, *induced)
        vectors = written(readers.vectors_of(norms, a.cache, match.hashed_ngrams, pack.model_name, pack.model_version) if a.cache else match.embed(norms, None)[0])
    scores, decisions = score.score_schema(gold, induced, runs, levels, pack, vectors, a.allow_inverse, a.masked)
    scores, decisions = written(scores), written(decisions)
    scores.write.mode("overwrite").parquet(f"{a.out}/table")
    about = found.select(F.col("run").alias("run_id"), F.coalesce("metadata.model", F.lit("unknown")).alias("model"), F.coalesce("metadata.condition", F.lit("unknown")).alias("condition"))
    rows = score.long_rows(scores, F.col("level")).withColumnRenamed("run", "run_id").join(about, "run_id")
    readers.write_scores(rows.select("run_id", "model", "condition", "level", "layer", "metric", "value"), f"{a.out}/scores")
    readers.write_documents(score.decision_documents(decisions, gold[0], induced[0], runs, levels), f"{a.out}/matches")
    views.score_view(scores, levels).show(1000, truncate=False)


def _induce(spark: SparkSession, a) -> None:
    sents = readers.corpus_sentences(spark, a.documents, a.folders, a.limit)
    classes, relations = terms.induce_schema(written(annotate.annotate(sents)), sents, a.classes)
    sources = [r.path for r in sents.select("path").distinct().orderBy("path").collect()]  # names only, they go into the output
    body = fixtures.ordered(classes, relations)
    meta = {"condition": "statistical", "model": "cvalue", "run_id": model_runs.run_id(), "source_documents": sources}
    readers.write_schema(model_runs.output(body, meta), a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("schemaloom").getOrCreate()
    if a.what == "score":
        _score(spark, a)
    elif a.what == "induce":
        _induce(spark, a)
    elif a.what == "instances":
        tables = {k: written(v) for k, v in instances.generate(spark, a.seed).items()}
        readers.write_instances(tables, instances.verify(tables), a.out)
    elif a.scores:
        views.score_view(spark.read.parquet(a.scores)).show(1000, truncate=False)
    elif a.induced:
        views.schema_view(*readers.schema_rows(readers.read_induced(spark, a.induced))).show(1000, truncate=False)
    else:
        raise SystemExit("show takes --induced or --scores")


if __name__ == "__main__":
    main()
