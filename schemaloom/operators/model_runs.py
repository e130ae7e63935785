"""Runs that ask a model for schemas: requests, calls, one schema per document or per corpus, consolidation.

A client is a callable that takes a request (a dict) and returns a response (a dict with content blocks, stop_reason,
usage and, after a refusal, stop_details). Errors are rows. Raw calls are written before anything is parsed, so a failed
run keeps them, and a task that runs again after the write calls no model.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from schemaloom.operators.induced import SCHEMA, clean_classes, clean_relations, explode_schema, parse_responses
from schemaloom.sources.tables import written

DOCUMENTS, SCHEMAS = "{{DOCUMENTS}}", "{{SCHEMAS}}"
#: Characters of a prompt for each token, an estimate.
CHARS_PER_TOKEN = 3.5


@dataclass(frozen=True)
class Model:
    """A model and how it is asked. style "blocks" sends content as text blocks, "plain" as a string with the model's id."""

    key: str
    model_id: str
    style: str = "plain"
    max_output_tokens: int = 16000
    temperature: float | None = 0.0
    top_p: float | None = 1.0
    thinking: bool = False
    effort: str | None = None
    extra: dict = field(default_factory=dict)


def build_request(model: Model, prompt: str) -> dict:
    """What is sent for a prompt: a function of both alone. Options that a model doesn't take (None, False) are left out."""
    if model.style == "blocks":
        content, out = [{"type": "text", "text": prompt}], dict(model.extra)
    elif model.style == "plain":
        content, out = prompt, {"model": model.model_id, **model.extra}
    else:
        raise ValueError(f"no request style {model.style!r} for model {model.key!r}")
    out |= {"max_tokens": model.max_output_tokens, "messages": [{"role": "user", "content": content}]}
    out |= {k: v for k, v in (("temperature", model.temperature), ("top_p", model.top_p)) if v is not None}
    if model.style == "plain" and model.thinking:
        out["thinking"] = {"type": "adaptive", "display": "summarized"}
    if model.style == "plain" and model.effort:
        out["output_config"] = {"effort": model.effort}
    return out


def read_response(response: dict) -> dict:
    """text, stop_reason, completion_tokens, error_kind and error of a response. Text blocks are joined; a refusal is told
    before a cut, a cut before blank text."""
    blocks = response.get("content") or []
    text = "".join(b.get("text") or "" for b in blocks if isinstance(b, dict) and b.get("type", "text") == "text")
    stop = response.get("stop_reason")
    kind = error = None
    if stop == "refusal":
        told = response.get("stop_details") or {}
        kind, error = "refused", " ".join(str(x) for x in ("refused", told.get("category"), told.get("explanation")) if x)
    elif stop == "max_tokens":
        kind, error = "truncated", "stopped at the output cap"
    elif not text.strip():
        kind, error = "empty", f"no text (stop_reason {stop!r})"
    return {"text": text, "stop_reason": stop, "completion_tokens": (response.get("usage") or {}).get("output_tokens"), "error_kind": kind, "error": error}


def retrying(client: Callable, attempts: int = 3, wait: float = 4.5, sleep: Callable = time.sleep) -> Callable:
    """A client that tries again after an error, after 2 x wait, 4 x wait ... seconds, and pauses after a success. Made for
    services that limit calls; refusals and cuts are answers and are not tried again."""

    def call(request: dict) -> dict:
        for n in range(1, attempts + 1):
            try:
                out = client(request)
                sleep(wait)
                return out
            except Exception as e:
                last = e
                sleep(wait * n * 2)
        raise RuntimeError(f"no answer after {attempts} attempts: {last}")

    return call


def run_id(now: datetime | None = None) -> str:
    """A UTC stamp and four hex digits; made once on the driver and passed on as a literal."""
    return f"{(now or datetime.now(timezone.utc)):%Y-%m-%dT%H:%M:%SZ}-{uuid.uuid4().hex[:4]}"


CALLS = "response string, stop_reason string, completion_tokens long, error_kind string, error string"


def call(prompts: DataFrame, model: Model, client: Callable) -> DataFrame:
    """prompts(id, prompt) -> (id, prompt_chars, response, stop_reason, completion_tokens, error_kind, error)."""

    def run(batches):
        for b in batches:
            rows = []
            for i, prompt in zip(b["id"], b["prompt"]):
                try:
                    r = read_response(client(build_request(model, prompt)))
                except Exception as e:  # errors are data here, so that a retry never calls again for the rows before
                    r = {"text": None, "stop_reason": None, "completion_tokens": None, "error_kind": "call", "error": str(e)}
                rows.append((i, len(prompt), *r.values()))
            yield pd.DataFrame(rows, columns=["id", "prompt_chars", *(c.split()[0] for c in CALLS.split(", "))])

    return prompts.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, prompt_chars long, {CALLS}")


def load_template(text: str, placeholder: str) -> str:
    if placeholder not in text:
        raise ValueError(f"the template has no {placeholder}")
    return text


def document_prompts(docs: DataFrame, template: str) -> DataFrame:
    """docs(ord, path, text) -> (id, path, prompt), one prompt for each document."""
    load_template(template, DOCUMENTS)
    one = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.trim("text"))
    return docs.select(F.col("ord").alias("id"), "path", F.replace(F.lit(template), F.lit(DOCUMENTS), one).alias("prompt"))


def consolidation_prompt(partial: DataFrame, template: str) -> DataFrame:
    """partial(id, source_document, classes, relations) -> (id, prompt): one prompt with all partial schemas as JSON, in order."""
    load_template(template, SCHEMAS)
    one = F.struct("source_document", "classes", "relations")
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("s")))), lambda x: x["s"]))
    return partial.agg(body.alias("body")).select(F.lit(0).alias("id"), F.replace(F.lit(template), F.lit(SCHEMAS), F.col("body")).alias("prompt"))


def dry_run(prompts: DataFrame) -> DataFrame:
    """(n_prompts, n_chars, est_tokens) of what would be sent."""
    n = F.sum(F.length("prompt"))
    return prompts.agg(F.count("*").alias("n_prompts"), n.alias("n_chars"), F.round(n / CHARS_PER_TOKEN).cast("long").alias("est_tokens"))


def cleaned(calls: DataFrame) -> DataFrame:
    """calls(id, response, error_kind) -> (id, classes, relations, error): the cleaned schema of each, or why there is none."""
    parsed = written(parse_responses(calls.where("error_kind is null")))
    classes, relations = explode_schema(parsed)
    c = clean_classes(classes).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "parent", "attributes"))).alias("c"))
    r = clean_relations(relations).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "label", "target"))).alias("r"))
    kind = SCHEMA.split(", relations ")
    empty = lambda t: F.array().cast(t)
    out = parsed.join(c, "id", "left").join(r, "id", "left")
    made_c = F.coalesce(F.expr("transform(c, x -> struct(x.name, x.parent, x.attributes))"), empty(kind[0].removeprefix("classes ")))
    made_r = F.coalesce(F.expr("transform(r, x -> struct(x.source, x.label, x.target))"), empty(kind[1]))
    known = out.select("id", made_c.alias("classes"), made_r.alias("relations"), "error")
    failed = calls.where("error_kind is not null").select("id", F.lit(None).cast(known.schema["classes"].dataType).alias("classes"), F.lit(None).cast(known.schema["relations"].dataType).alias("relations"), F.coalesce("error", "error_kind").alias("error"))
    return known.where("error is null").union(known.where("error is not null").select("id", F.lit(None), F.lit(None), "error")).union(failed)


def output(schema: DataFrame, metadata: dict) -> DataFrame:
    """schema(classes, relations) -> (schema_json) with the metadata of the run."""
    made = schema.select("classes", "relations", F.lit(json.dumps(metadata)).alias("m"))
    body = F.to_json(F.struct("classes", "relations"), {"ignoreNullFields": "false"})
    return made.select(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(', "metadata": '), F.col("m"), F.lit("}")).alias("schema_json"))


def extract_documents(docs: DataFrame, model: Model, client: Callable, template: str, calls_path: str) -> DataFrame:
    """One call for each document of docs(ord, path, text): (id, source_document, classes, relations, error).

    The calls are written to ``calls_path`` as JSON lines first. A document that fails keeps its error and is skipped by
    what follows; if all fail the run has failed."""
    prompts = document_prompts(docs, template)
    call(prompts, model, client).write.mode("overwrite").json(calls_path)
    kind = docs.schema["ord"].dataType.simpleString()
    calls = docs.sparkSession.read.schema(f"id {kind}, prompt_chars long, {CALLS}").json(calls_path)
    out = written(cleaned(calls).join(prompts.select("id", F.col("path").alias("source_document")), "id"))
    if out.where("error is null").isEmpty():
        raise RuntimeError("no document gave a schema; the calls are in " + calls_path)
    return out.select("id", "source_document", "classes", "relations", "error")


def _single(prompt: DataFrame, model: Model, client: Callable, calls_path: str) -> tuple[DataFrame, dict]:
    """The cleaned schema of one call, and the call; any failure is fatal, after the call has been written."""
    call(prompt, model, client).coalesce(1).write.mode("overwrite").json(calls_path)
    calls = prompt.sparkSession.read.schema(f"id {prompt.schema['id'].dataType.simpleString()}, prompt_chars long, {CALLS}").json(calls_path)
    out = written(cleaned(calls))
    row, first = out.select("error").first(), calls.select("stop_reason", "completion_tokens").first()
    if row is None or row.error is not None:
        raise RuntimeError(f"the call failed: {row and row.error}; it is kept in {calls_path}")
    return out.select("classes", "relations"), first.asDict()


def run_staged(docs: DataFrame, model: Model, client: Callable, templates: tuple[str, str], folder: str, condition: str, run: str) -> DataFrame:
    """(schema_json) of a staged run: a schema for each document, then one call that consolidates them."""
    partial = extract_documents(docs, model, client, templates[0], f"{folder}/{run}_documents.jsonl")
    good = partial.where("error is null")
    schema, last = _single(consolidation_prompt(good, templates[1]), model, client, f"{folder}/{run}_consolidation.jsonl")
    n, ok = partial.count(), good.count()
    sources = [r.path for r in docs.orderBy("ord").select("path").collect()]  # names only, they go into the output
    return output(schema, {"condition": condition, "model": model.model_id, "run_id": run, "source_documents": sources, "extraction_calls": n, "extraction_skipped": n - ok, "consolidation_stop_reason": last["stop_reason"], "consolidation_completion_tokens": last["completion_tokens"]})


def run_whole(docs: DataFrame, model: Model, client: Callable, template: str, folder: str, condition: str, run: str) -> DataFrame:
    """(schema_json) of a single call over the whole corpus, documents in order; a failure is fatal."""
    load_template(template, DOCUMENTS)
    one = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.trim("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "\n\n")
    prompt = docs.agg(body.alias("body")).select(F.lit(0).alias("id"), F.replace(F.lit(template), F.lit(DOCUMENTS), F.col("body")).alias("prompt"))
    schema, last = _single(prompt, model, client, f"{folder}/{run}_call.jsonl")
    sources = [r.path for r in docs.orderBy("ord").select("path").collect()]  # names only, they go into the output
    return output(schema, {"condition": condition, "model": model.model_id, "run_id": run, "source_documents": sources, **last})
