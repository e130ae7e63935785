"""Corpus pipeline: filter, deduplicate and pack ``documents``.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns the rows kept with the
columns of ``docs`` (the last: the packing). Every stage's result is written and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from schemaloom.llm import packing, quality_rules, simhash_dedup, substring_dedup, toxicity
from schemaloom.llm.common import discard, materialise, table


def _beside(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one column, all columns but the text, which travel with a document so that nothing is joined."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("whole"))


def _back(rows: DataFrame, docs: DataFrame, fresh: dict) -> DataFrame:
    """The columns of ``docs`` again, those of ``fresh`` from there."""
    return rows.select(*(fresh[c].alias(c) if c in fresh else F.col("text") if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns))


def _accepted(docs: DataFrame, score) -> DataFrame:
    """The documents that ``score`` keeps, in one pass."""
    return _back(score(_beside(docs)).where("kept"), docs, {})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees accept."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return _accepted(docs, lambda d: quality_rules.score(d, model, extra=("text", "whole")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _accepted(docs, lambda d: toxicity.score(d, model, extra=("text", "whole")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (5-word shingles, 0.8): the one with the smallest id, null ids last."""
    return simhash_dedup.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has. Texts without such passages stay as they are."""
    cut = substring_dedup.dedup(_beside(docs), extra=("text", "whole"))
    changed, fresh = F.col("n_removed") > 0, {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
        fresh["n_chars"] = n
    return _back(cut, docs, fresh)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every word of every document."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("simhash_dedup", near_dedup), ("substring_dedup", repeats), ("best_fit_packing", pack)]

#: SQL can't express training, recompression or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if n:
            discard(before)
    return docs
