"""Sources, sinks, model runs, instances, documents and whole scorings, on small written-out inputs."""

import json

import pytest
from pyspark.sql import functions as F

from schemaloom.functions import text as T
from schemaloom.operators import annotate as A, fixtures as X, induced as I, instances as N, match as M, model_runs as U, score as S, terms as R
from schemaloom.sources import readers, tables
from schemaloom.streaming import events


CLASSES = "name string, parent string, attributes array<string>"
RELATIONS = "source string, label string, target string"


@pytest.fixture(scope="module")
def gold(spark):
    """Two kinds of party, a lease between them and a unit; twelve attributes' worth of inheritance is in Party's."""
    c = [("Party", None, ["name", "phone"]), ("Owner", "Party", ["tax id"]), ("Tenant", "Party", ["business"]), ("Unit", None, ["floor", "area"]), ("Lease", None, ["rent", "start date", "end date"])]
    r = [("Lease", "has party", "Owner"), ("Lease", "has party", "Tenant"), ("Lease", "covers", "Unit"), ("Owner", "owns", "Unit"), ("Lease", "has amendment", "Lease")]
    return spark.createDataFrame(c, CLASSES), spark.createDataFrame(r, RELATIONS)


PACK = M.Pack(synonyms=(("owner", "landlord"), ("tenant", "lessee"), ("tenant", "renter"), ("unit", "space")))


def test_toy_schemas(spark, gold):
    toys = {
        "T1": gold,
        "T2": (gold[0].limit(0), gold[1].limit(0)),
        "T3": X.rename(gold, {"Owner": "Landlord", "Tenant": "Lessee", "Unit": "Space"}),
        "T4": X.add_classes(gold, ["Zoning Permit", "Utility Account", "Parking Sticker", "Signage Placard", "Insurance Policy"]),
        "T5": X.keep_half(gold),
        "T6": X.flatten(gold),
        "T7": X.split(gold, "Tenant", ["Renter", "Lessee"]),
        "T8": X.reverse(gold),
        "T9": X.relabel(gold, {("has party", "Owner"): "hasOwnerParty", ("has party", "Tenant"): "hasTenantParty"}),
    }
    made = [X.as_run(s, n) for n, s in toys.items()]
    classes, relations = made[0]
    for a, b in made[1:]:
        classes, relations = classes.union(a), relations.union(b)
    classes, relations = tables.written(classes), tables.written(relations)
    runs = spark.createDataFrame([(n,) for n in toys], "run string")
    scores, decisions = S.score_schema(gold, (classes, relations), runs, ("M1", "M2"), PACK, inverse=True)
    decisions = tables.written(decisions)
    rows = scores.collect()
    got = {(r.run, r.level, r.layer): (r.tp, r.fp, r.fn) for r in rows}
    f1 = {(r.run, r.level, r.layer): r.f1 for r in rows}
    assert len(rows) == 9 * 2 * 8 and not any(r.n_a for r in rows)
    for level in ("M1", "M2"):
        assert all(f1["T1", level, layer] == 1.0 for layer in ("classes", "taxonomy", "attributes_effective_micro", "attributes_effective_macro", "attributes_declared_micro", "relations", "relations_allow_inverse"))
        assert got["T2", level, "classes"] == (0, 0, 5) and got["T2", level, "relations"] == (0, 0, 5) and f1["T2", level, "classes"] == 0.0
        assert got["T4", level, "classes"] == (5, 5, 0)
        assert got["T5", level, "classes"] == (2, 0, 3)
        assert got["T6", level, "classes"] == (5, 0, 0) and got["T6", level, "taxonomy"] == (0, 0, 2)
        assert got["T6", level, "attributes_effective_micro"] == (9, 0, 4) and got["T6", level, "attributes_declared_micro"] == (9, 0, 0)
        assert got["T8", level, "relations"] == (1, 4, 4) and f1["T8", level, "relations_allow_inverse"] == 1.0
        assert f1["T9", level, "classes"] == 1.0
    assert got["T3", "M1", "classes"] == (2, 3, 3) and got["T3", "M2", "classes"] == (5, 0, 0) and f1["T3", "M2", "relations"] == 1.0
    assert got["T7", "M1", "classes"] == (4, 2, 1) and got["T7", "M2", "classes"] == (5, 1, 0)
    assert got["T9", "M1", "relations"] == (3, 2, 2)

    documents = {(r.run, r.level): json.loads(r.document) for r in S.decision_documents(decisions, gold[0], classes, runs, ("M1", "M2")).collect()}
    assert len(documents) == 18 and documents["T2", "M1"]["classes_unmatched_gold"] == ["Lease", "Owner", "Party", "Tenant", "Unit"]
    assert documents["T7", "M2"]["classes_unmatched_induced"] and len(documents["T7", "M2"]["classes_matched"]) == 5
    sizes = {r.run: tuple(r)[1:] for r in S.schema_sizes(classes, relations, runs).collect()}
    assert sizes["T1"] == (5, 9, 5) and sizes["T2"] == (0, 0, 0)

    found = S.mismatches(gold, (classes, relations), decisions, runs, "M2", PACK).groupBy("run", "kind").count().collect()
    kinds = {(r.run, r.kind): r["count"] for r in found}
    assert kinds["T2", "missing_class"] == 5 and kinds["T4", "spurious_class"] == 5 and kinds["T6", "flattened_taxonomy"] == 2
    assert kinds["T7", "split_class"] == 1 and kinds["T8", "reversed_relation"] == 4 and not any(run == "T1" for run, _ in kinds)
    some = S.sample_decisions(decisions, "M2", 7).collect()
    assert len(some) == 7 and some == S.sample_decisions(decisions, "M2", 7).collect()


def test_third_level_rests_on_vectors(spark, tmp_path):
    side = lambda *names: spark.createDataFrame([("s", n, n) for n in names], "scope string, id string, name string")
    calls = []
    vectors = {"owner": [1.0, 0.0], "landlord": [0.9, 0.1], "tree": [0.0, 1.0]}
    norms = spark.createDataFrame([(n,) for n in vectors], "norm string")
    path = str(tmp_path / "cache")
    encode = lambda n: vectors[n]
    got = readers.vectors_of(norms, path, encode, "toy", "1")
    assert {r.norm: r.vector for r in got.collect()} == vectors
    fail = lambda n: calls.append(n) or 1 / 0
    again = readers.vectors_of(norms, path, fail, "toy", "1")
    assert again.count() == 3 and readers.read_cache(spark, path).count() == 3
    assert readers.vectors_of(norms.limit(1), path, lambda n: [0.5], "toy", None).first().vector == [0.5]
    found = M.match(side("owner", "tree"), side("landlord"), "M3", vectors=again).collect()
    assert [(r.gold, r.induced) for r in found] == [("owner", "landlord")]
    assert M.cosine is not None and len(M.hashed_ngrams("lease")) == 256
    near, far = (sum(x * y for x, y in zip(M.hashed_ngrams("lease agreement"), M.hashed_ngrams(w))) for w in ("lease agreements", "tree"))
    assert near > 0.8 > far
    assert S.names_of(spark.createDataFrame([("A", ["Has B"])], "name string, attributes array<string>")).count() == 2


def test_pack(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("stopwords: [the]\nsynonyms:\n  owner: [Landlords, proprietor]\nthresholds: {m2_token_set_ratio: 0.9}\nembedding: {model_name: m, model_version: null}\n")
    pack = readers.read_pack(spark, str(tmp_path / "p.yaml"))
    assert pack.synonyms == (("owner", "landlord"), ("owner", "proprietor")) and pack.m2_threshold == 0.9 and pack.m3_threshold == 0.55 and pack.model_name == "m"
    score, threshold = M.scorer_of("M2", pack)
    assert score("landlord", "owner") == 1.0 and score("landlord", "proprietor") < threshold == 0.9


def test_induced_files(spark, tmp_path):
    one = {"classes": [{"name": "A", "attributes": ["x"]}, {"name": "B"}, {"name": "A", "parent": "B", "attributes": ["y", "y"]}], "relations": [{"source": "A", "label": "l", "target": "B"}] * 2, "metadata": {"run_id": "r1", "model": "m"}}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text("{}")
    found = readers.read_induced(spark, str(tmp_path))
    classes, relations = readers.schema_rows(found)
    assert sorted(tuple(r) for r in classes.collect()) == [("r1", "A", "B", ["y"]), ("r1", "B", None, [])]
    assert [tuple(r) for r in relations.collect()] == [("r1", "A", "l", "B")]
    meta = {r.run: r.metadata for r in readers.read_metadata(spark, str(tmp_path)).collect()}
    assert meta["r1"].model == "m" and meta["two"] is None
    (tmp_path / "two.json").write_text('{"classes": [{"parent": "A"}]}')
    with pytest.raises(Exception, match="without a name"):
        readers.schema_rows(readers.read_induced(spark, str(tmp_path)))[0].collect()


def test_documents_in_turn(spark, tmp_path):
    for folder, names in (("a", ("1.txt", "2.md", "3.csv", "4.txt")), ("b", ("1.txt",)), ("c", ("9.txt",))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text(f"{folder}{n}")
    read = lambda **how: [(r.ord, r.text) for r in readers.read_documents(spark, str(tmp_path), ["b", "a"], **how).orderBy("ord").collect()]
    assert read() == [(0, "b1.txt"), (1, "a1.txt"), (2, "a3.csv"), (3, "a4.txt")]
    assert [t for _, t in read(limit=2)] == ["b1.txt", "a1.txt", "a3.csv"]
    assert [t for _, t in read(limit=2, filter_first=False)] == ["b1.txt", "a1.txt"]
    files = spark.createDataFrame([("p", "a,b\n1,\n,\n2, x\n"), ("q", None)], "path string, text string")
    assert [tuple(r) for r in readers.csv_sentences(files).collect()] == [("p", 0, "a: 1"), ("p", 2, "a: 2, b: x")]


def test_latest_run(spark, tmp_path):
    import os

    assert readers.latest(spark, str(tmp_path / "none"), "*.json") is None
    for k, name in enumerate(("r2_x.json", "r1_x.json", "other.txt")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    run, path, scores = readers.latest_run(spark, str(tmp_path), str(tmp_path), "_x.json")
    assert run == "r1" and path.endswith("r1_x.json") and scores is None
    (tmp_path / "r1.csv").write_text("a")
    assert readers.latest_run(spark, str(tmp_path), str(tmp_path), "_x.json")[2].endswith("r1.csv")


def test_sinks(spark, tmp_path, gold):
    rows = S.long_rows(spark.createDataFrame([("r", "classes", 1, 0, 0, 1.0, None, 0.5)], "run string, layer string, tp long, fp long, fn long, precision double, recall double, f1 double"), "M1")
    readers.write_scores(rows, str(tmp_path / "scores"))
    back = spark.read.csv(str(tmp_path / "scores"), header=True)
    assert back.count() == 6 and back.where("metric = 'recall'").first().value is None
    readers.write_documents(spark.createDataFrame([("r", "{}")], "run string, document string"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first().value == "{}"
    made = X.to_contract(gold, "T1")
    assert readers.write_schema(made, str(tmp_path / "schema")) and not readers.write_schema(made.limit(0), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists() and len(json.loads(spark.read.text(str(tmp_path / "schema")).first().value)["classes"]) == 5
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    for _ in range(2):
        tables.append_new(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_upserts_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        events.upsert_new(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def answer(classes, stop="end_turn"):
    return {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "<think>x</think>```json\n" + json.dumps({"classes": [{"name": c} for c in classes], "relations": []}) + "\n```"}], "stop_reason": stop, "usage": {"output_tokens": 3}}


def stub(request):
    prompt = request["messages"][0]["content"]
    if "consolidate" in prompt:
        return answer(["Owner", "owner ", "Lease"])
    if "boom" in prompt:
        raise RuntimeError("down")
    if "refuse" in prompt:
        return answer([], "refusal") | {"stop_details": {"category": "c", "explanation": "e"}}
    if "cut" in prompt:
        return answer(["x"], "max_tokens")
    return {"content": [], "stop_reason": "end_turn"} if "blank" in prompt else answer(["Owner"])


def test_requests_and_responses():
    plain = U.build_request(U.Model("k", "id", temperature=None, top_p=None, thinking=True, effort="high"), "p")
    assert plain == {"model": "id", "max_tokens": 16000, "messages": [{"role": "user", "content": "p"}], "thinking": {"type": "adaptive", "display": "summarized"}, "output_config": {"effort": "high"}}
    blocks = U.build_request(U.Model("k", "id", "blocks", 9, top_p=None, extra={"version": "v"}), "p")
    assert blocks == {"version": "v", "max_tokens": 9, "messages": [{"role": "user", "content": [{"type": "text", "text": "p"}]}], "temperature": 0.0}
    with pytest.raises(ValueError):
        U.build_request(U.Model("k", "id", "odd"), "p")
    kinds = {p: U.read_response(stub({"messages": [{"content": p}]}))["error_kind"] for p in ("fine", "refuse", "cut", "blank")}
    assert kinds == {"fine": None, "refuse": "refused", "cut": "truncated", "blank": "empty"}
    assert "c e" in U.read_response(stub({"messages": [{"content": "refuse"}]}))["error"]
    waits, tries = [], []

    def flaky(request):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return "ok"

    assert U.retrying(flaky, wait=1.0, sleep=waits.append)({}) == "ok" and waits == [2.0, 4.0, 1.0]
    with pytest.raises(RuntimeError, match="3 attempts"):
        U.retrying(lambda r: 1 / 0, sleep=waits.append)({})
    assert len(U.run_id()) == 25


def test_staged_and_whole_runs(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a.txt", "fine"), (1, "b.txt", "boom"), (2, "c.txt", "refuse"), (3, "d.txt", "cut"), (4, "e.txt", "blank"), (5, "f.txt", " good ")], "ord long, path string, text string")
    model, templates = U.Model("k", "id"), ("Read {{DOCUMENTS}}", "consolidate {{SCHEMAS}}")
    out = json.loads(U.run_staged(docs, model, stub, templates, str(tmp_path), "P", "r1").first().schema_json)
    assert [c["name"] for c in out["classes"]] == ["Owner", "Lease"] and out["classes"][0] == {"name": "Owner", "parent": None, "attributes": []}
    assert out["metadata"] | {"source_documents": 0} == {"condition": "P", "model": "id", "run_id": "r1", "source_documents": 0, "extraction_calls": 6, "extraction_skipped": 4, "consolidation_stop_reason": "end_turn", "consolidation_completion_tokens": 3}
    raw = spark.read.json(str(tmp_path / "r1_documents.jsonl"))
    assert raw.count() == 6 and raw.where("error_kind is not null").count() == 4
    whole = json.loads(U.run_whole(docs.where("ord in (0, 5)"), model, stub, templates[0], str(tmp_path), "B", "r2").first().schema_json)
    assert whole["metadata"]["stop_reason"] == "end_turn" and whole["metadata"]["source_documents"] == ["a.txt", "f.txt"]
    with pytest.raises(RuntimeError, match="call failed"):
        U.run_whole(docs, model, stub, templates[0], str(tmp_path), "B", "r3")
    assert spark.read.json(str(tmp_path / "r3_call.jsonl")).count() == 1
    with pytest.raises(RuntimeError, match="no document"):
        U.extract_documents(docs.where("ord = 1"), model, stub, templates[0], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        U.document_prompts(docs, "none")
    sized = U.dry_run(U.document_prompts(docs, templates[0])).first()
    assert sized.n_prompts == 6 and sized.est_tokens == round(sized.n_chars / 3.5)
    partial = I.consolidate(spark.createDataFrame([("Owner", "Party", ["a"]), ("owner", None, ["A", "b"]), ("Owner", None, [])], "name string, parent string, attributes array<string>")).collect()
    assert [(r.name, r.parent, r.support, r.attributes) for r in partial] == [("Owner", "Party", 3, ["a", "b"])]


def test_instances(spark, tmp_path):
    t = {k: tables.written(v) for k, v in N.generate(spark).items()}
    assert N.verify(t).count() == 0
    assert {k: v.count() for k, v in t.items() if k != "leases"} == {"owners": 18, "agents": 14, "vendors": 12, "properties": 45, "tenants": 35, "maintenance_requests": 65}
    assert 35 <= t["leases"].count() <= 70 and {r.serviceType for r in t["vendors"].collect()} == set(N.SERVICE_TYPES)
    r = t["maintenance_requests"]
    assert r.where("status = 'open' and resolvingVendorId is not null or (status = 'resolved') <> (dateResolved is not null) or (estimatedCost > 1000) <> (requiresApprovalOwnerId is not null)").count() == 0
    served = r.join(t["vendors"].select(F.col("id").alias("resolvingVendorId"), "serviceType"), "resolvingVendorId")
    assert served.where("not startswith(description, serviceType)").count() == 0 < served.count()
    again = N.generate(spark)["leases"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, t["leases"].collect()))
    later = t["leases"].alias("a").join(t["leases"].alias("b"), F.col("a.amendmentLeaseId") == F.col("b.id"))
    assert later.where("a.endDate <> b.startDate or a.propertyId <> b.propertyId").count() == 0 < later.count()

    bad = dict(t)
    bad["leases"] = t["leases"].withColumn("tenantId", F.when(F.col("id") == t["leases"].first().id, "ten-999").otherwise(F.col("tenantId")))
    bad["agents"] = t["agents"].union(t["agents"].limit(1))
    rules = {x.rule for x in N.verify(bad).collect()}
    assert {"leases.tenantId", "duplicate id"} <= rules
    with pytest.raises(ValueError):
        readers.write_instances(bad, N.verify(bad), str(tmp_path / "bad"))
    readers.write_instances(t, N.verify(t), str(tmp_path / "good"))
    assert not (tmp_path / "bad").exists() and spark.read.json(str(tmp_path / "good" / "owners")).count() == 18

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "owners.json").write_text(json.dumps([{"id": "own-001", "name": "A"}, {"id": "own-002", "name": "B"}]))
    assert {k: v.count() for k, v in readers.read_instances(spark, str(tmp_path / "in")).items()} == {"owners": 2}

    leases = N.resolve_leases(t)
    assert leases.count() == t["leases"].count() and not any(c.endswith("Id") or c == "id" for c in leases.columns)
    whole, cut = leases.where("amendmentSummary is not null").count(), N.resolve_leases(t, 1).where("amendmentSummary is not null").count()
    assert whole == t["leases"].where("amendmentLeaseId is not null").count() > cut == 0
    assert N.resolve_properties(t).count() == 45 and N.resolve_requests(t).count() == 65
    assert sorted(r["count"] for r in N.batches(t["tenants"], "id", 15).groupBy("batch").count().collect()) == [5, 15, 15]


def test_documents_from_instances(spark, tmp_path):
    df = spark.createDataFrame([(k, f"name {k}", None if k else "x") for k in range(5)], "id long, name string, vendor string")
    prompts = N.record_prompts(df, "id", "About [NAME], vendor [VENDOR]", {"[NAME]": "name", "[VENDOR]": "vendor"})
    assert {r.id: r.prompt for r in prompts.collect()}[1] == "About name 1, vendor null (not assigned)"
    batch = N.batch_prompts(N.batches(df, "id", 3), "Avoid {{NAMES}}: {{RECORDS}}", ["rent", "status"]).orderBy("id").collect()
    assert len(batch) == 2 and batch[1].prompt.startswith("Avoid rent, status: [{") and "name 4" in batch[1].prompt
    with pytest.raises(ValueError):
        N.batch_prompts(N.batches(df, "id", 3), "none", [])
    assert {r[0] for r in df.select(N.pairing(F.col("id"))).collect()} <= {"tenant-agent", "agent-vendor"}
    path = str(tmp_path / "made")

    def client(prompt):
        if "name 3" in prompt:
            raise OSError("down")
        return prompt.upper()

    count = lambda rows: {r.outcome: r.n for r in rows.collect()}
    assert count(N.make_documents(prompts, "notes", client, path)) == {"generated": 4, "failed": 1, "skipped": 0}
    assert count(N.make_documents(prompts, "notes", str.upper, path)) == {"generated": 1, "skipped": 4}
    assert count(N.make_documents(prompts, "notes", lambda p: "new", path, force=True)) == {"generated": 5, "skipped": 0}
    assert {r.text for r in spark.read.parquet(path).collect()} == {"new"}
    checked = N.make_documents(prompts, "csv", lambda p: "{}", path, check=N.table_from_json)
    assert count(checked) == {"failed": 5, "skipped": 0}
    for text, why in (("x", "not JSON"), ("[]", "missing"), ('{"columns": 1, "rows": []}', "lists"), ('{"columns": [], "rows": []}', "no columns"), ('{"columns": ["a"], "rows": [[1, 2]]}', "1 rows")):
        assert N.table_from_json(text)[0] is None and why in N.table_from_json(text)[1]
    assert N.table_from_json('```json\n{"columns": ["a", "b"], "rows": [["x, y", ""]]}\n```') == ('a,b\r\n"x, y",\r\n', None)


def test_annotations():
    tagged = lambda s: {t[1]: t[3:6] for t in A.annotate_one(s)[0]}
    got = tagged("The vendor resolved the maintenance request.")
    assert got["vendor"] == ("NOUN", "nsubj", 2) and got["resolved"][0] == "VERB" and got["request"] == ("NOUN", "dobj", 2) and got["maintenance"][1] == "compound"
    assert A.verb_lemma("managing") == "manage" and A.verb_lemma("paid") == "pay" and A.verb_lemma("supplies") == "supply" and A.verb_lemma("submitted") == "submit" and A.verb_lemma("tenant") is None
    assert tagged("Owners pay for repairs.")["repairs"][1] == "pobj"
    tokens, chunks = A.annotate_one("the start date of the lease")
    assert chunks == [(0, 3), (4, 6)] and A.annotate_one("") == ([], [])


def test_grammar_patterns(spark):
    sents = ["The tenant's phone number rings.", "tenant: deposit", "the rent of the tenant", "tenant deposit", "tenant and deposit", "the tenant tenant name"]
    tagged = A.annotate(spark.createDataFrame(list(enumerate(sents)), "sent_id long, sentence string"))
    classes = spark.createDataFrame([("tenant",)], "term string")
    terms = spark.createDataFrame([(x,) for x in ("phone number", "deposit", "rent", "tenant name", "tenant")], "term string")
    got = {r["attr"]: r.n for r in R.grammar_attributes(tagged, classes, terms).collect()}
    assert got == {"phone number": 1, "deposit": 2, "rent": 1}


def test_induced_schema_of_a_corpus(spark):
    sents = ["The Owner signs the lease."] * 4 + ["The owner signs a lease."] * 3 + ["the rent amount of the lease"] * 3 + [None]
    rows = spark.createDataFrame(list(enumerate(sents)), "sent_id long, sentence string")
    tagged = tables.written(A.annotate(rows))
    classes, relations = R.induce_schema(tagged, rows, n_classes=2)
    got = [(r.name, r.parent, r.attributes) for r in classes.orderBy("pos").collect()]
    assert got == [("lease", None, ["amount", "rent amount"]), ("Owner", None, [])]
    assert [(r.source, r.label, r.target) for r in relations.orderBy("pos").collect()] == [("Owner", "sign", "lease")]
    empty = R.induce_schema(tagged.limit(0), rows.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_frequencies_from_terms_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "a", "en", "s", 1), (-3, "", "en", "s", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema))
    slow = R.frequencies(R.ngrams(R.sentences(docs)))
    assert sorted(map(tuple, R.ngram_frequencies(docs).collect())) == sorted(map(tuple, slow.collect()))


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.surface(F.lit("The Owner"), F.lit("the owner"), F.lit(4), F.lit(9))) == "Owner"
    assert one(T.surface(F.lit("\u0130stanbul Owner"), F.lit("i\u0307stanbul owner"), F.lit(10), F.lit(15))) == "owner"
    assert str(one(T.random_date(2022, 2023, F.lit(0.0)))) == "2022-01-01" and str(one(T.random_date(2022, 2023, F.lit(0.9999999)))) == "2023-12-31"
    assert one(T.email(F.lit("Ada Boyd"), F.lit("My Firm"))) == "ada.boyd@myfirm.com"


def test_command_line(spark, tmp_path, gold, capsys):
    from schemaloom.__main__ import main

    (tmp_path / "docs" / "notes").mkdir(parents=True)
    (tmp_path / "docs" / "rows").mkdir()
    (tmp_path / "docs" / "notes" / "a.txt").write_text("The owner signs the lease. " * 4 + "\n\nThe rent amount of the lease. " * 3)
    (tmp_path / "docs" / "rows" / "b.csv").write_text("owner,phone\n" + "Ada,1\n" * 3)
    main(["induce", "--documents", str(tmp_path / "docs"), "--folders", "notes", "rows", "--out", str(tmp_path / "made")], spark)
    text = spark.read.text(str(tmp_path / "made")).first().value
    made = json.loads(text)
    assert {"owner", "lease"} <= {c["name"] for c in made["classes"]} and len(made["metadata"]["source_documents"]) == 2
    assert {"source": "owner", "label": "sign", "target": "lease"} in made["relations"]
    (tmp_path / "run.json").write_text(text)
    (tmp_path / "gold.ttl").write_text("""@prefix : <http://x.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Owner a owl:Class . :Lease a owl:Class . :rentAmount a owl:DatatypeProperty ; rdfs:domain :Lease .
:signs a owl:ObjectProperty ; rdfs:domain :Owner ; rdfs:range :Lease .
""")
    args = ["score", "--gold", str(tmp_path / "gold.ttl"), "--induced", str(tmp_path / "run.json"), "--out", str(tmp_path / "out"), "--allow-inverse"]
    main(args, spark)
    table = spark.read.csv(str(tmp_path / "out" / "scores"), header=True)
    got = {(r.level, r.layer, r.metric): r.value for r in table.collect()}
    assert table.columns == ["run_id", "model", "condition", "level", "layer", "metric", "value"] and len(got) == 3 * 8 * 6
    assert got["M1", "classes", "tp"] == "2.0" and got["M1", "relations", "tp"] == "1.0" and got["M1", "taxonomy", "f1"] is None
    assert spark.read.text(str(tmp_path / "out" / "matches")).count() == 3
    capsys.readouterr()
    main(["show", "--scores", str(tmp_path / "out" / "table")], spark)
    main(["show", "--induced", str(tmp_path / "run.json")], spark)
    shown = capsys.readouterr().out
    assert "relations_allow_inverse" in shown and "owner --sign-> lease" in shown
    with pytest.raises(SystemExit):
        main(["show"], spark)
