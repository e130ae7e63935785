import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.functions import text as T
from schemaloom.operators import induced as I, integrity as G, match as M, score as S, terms as R
from schemaloom.plans import queries as Q
from schemaloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_normalize(spark):
    forms = {one(spark, T.normalize(F.lit(x))) for x in ("MaintenanceRequest", "maintenance_request", "Maintenance Requests")}
    assert forms == {"maintenance request"}
    assert one(spark, T.normalize(F.lit("Properties"))) == "property" != one(spark, T.normalize(F.lit("Premises")))


@pytest.mark.parametrize("text,want", [("<think>{a}</think> b", "b"), ("x</think>tail", "tail"), ("<think> open", "<think> open"), ("<think>a</think>b <THINK>c", "b <THINK>c")])
def test_strip_reasoning(spark, text, want):
    assert one(spark, T.strip_reasoning(F.lit(text))) == want


def test_fuzzy_anchors():
    assert M.fuzzy("lease", "least") == 0.8
    assert M.fuzzy("widget", "office widget") < 1
    assert M.fuzzy("a b", "a b") == 1
    got = [M.fuzzy(a, b) for a, b in (("has owner party", "has party"), ("represents owner", "represent"))]
    assert got[0] == 0.75


@pytest.mark.parametrize("shape", [(0, 3), (1, 1), (3, 5), (6, 4), (5, 5)])
def test_assignment_equals_brute_force(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        s = rng.random(shape)
        got = M.assign(s)
        n, m = shape
        small, large = min(n, m), max(n, m)
        sums = [sum(s[i, p[i]] if n <= m else s[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small)]
        assert len(got) == small and math.isclose(sum(s[i, j] for i, j in got), max(sums))


def test_threshold_comes_after_the_optimum(spark):
    score = {("g1", "i1"): 0.9, ("g1", "i2"): 0.84, ("g2", "i1"): 0.84, ("g2", "i2"): 0.0}
    side = lambda k: spark.createDataFrame([("s", f"{k}{n}", f"{k}{n}") for n in (1, 2)], "scope string, id string, value string")
    scorer = lambda a, b: score[a, b]
    assert M.match_scored(side("g"), side("i"), scorer, 0.85).count() == 0
    assert [r.gold for r in M.match_scored(side("g"), side("i"), scorer, 0.85, masked=True).collect()] == ["g1"]


def test_synonyms_match_at_m2(spark):
    pack = {"owner": ["landlord", "proprietor"]}
    score = M.m2_scorer(pack)
    assert score("owner", "landlord") == score("proprietor", "owner") == 1.0 and score("landlord", "proprietor") < M.M2_THRESHOLD
    assert score("lease", "least") == 0.8 and score("a b", "a b") == 1.0
    assert M.synonym_pairs(pack, spark).count() == 4
    side = lambda *names: spark.createDataFrame([("s", n, n) for n in names], "scope string, id string, value string")
    got = M.match_scored(side("owner", "lease"), side("landlord", "least"), score, M.M2_THRESHOLD).collect()
    assert [tuple(r) for r in got] == [("s", "owner", "landlord", 1.0)]


def test_cosine_assignment_at_m3(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.6, 0.8]), ("d", [0.0, 1.0]), ("z", [0.0, 0.0])]
    vectors = spark.createDataFrame(vectors, "norm string, vector array<double>")
    side = lambda *names: spark.createDataFrame([("s", f"{k} {n}", n) for k, n in enumerate(names)], "scope string, id string, norm string")
    got = {r.gold: (r.induced, round(r.score, 6)) for r in M.match_cosine(side("a", "d", "z", "none"), side("b", "c", "none"), vectors).collect()}
    assert got == {"0 a": ("0 b", 0.8), "1 d": ("1 c", 0.8), "3 none": ("2 none", 1.0)}
    assert M.match_cosine(side("a"), side("c"), vectors, 0.61).count() == 0


def test_levels(spark):
    side = lambda *names: spark.createDataFrame([("s", n, n) for n in names], "scope string, id string, name string")
    pack = M.Pack(synonyms=(("owner", "landlord"),))
    got = {lv: {(r.gold, r.induced) for r in M.match(side("Owner", "Steel Bolts", "lease"), side("landlord", "bolt_steel", "Leases"), lv, pack).collect()} for lv in ("M1", "M2")}
    assert got == {"M1": {("lease", "Leases")}, "M2": {("lease", "Leases"), ("Owner", "landlord"), ("Steel Bolts", "bolt_steel")}}
    for level in ("M0", None):
        with pytest.raises(ValueError):
            M.match(side("a"), side("a"), level)
    with pytest.raises(ValueError):
        M.match(side("a"), side("a"), "M3")


def test_equal_sums_go_to_exact_pairs_then_smaller_ids(spark):
    side = lambda *ids: spark.createDataFrame([("s", i, i) for i in ids], "scope string, id string, value string")
    got = M.match_scored(side("b", "a", "c"), side("z", "x", "y"), lambda a, b: 0.9, 0.85).orderBy("gold").collect()
    assert [(r.gold, r.induced) for r in got] == [("a", "x"), ("b", "y"), ("c", "z")]
    score = {("a", "x"): 1.0, ("a", "y"): 0.9, ("b", "x"): 0.9, ("b", "y"): 0.8}
    got = M.match_scored(side("a", "b"), side("x", "y"), lambda a, b: score[a, b], 0.8).collect()
    assert {(r.gold, r.induced) for r in got} == {("a", "x"), ("b", "y")}


def test_indel_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 14))) for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert M.indel(a, b) == (2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_c_value_by_hand(spark):
    terms = spark.createDataFrame([("maintenance request", 2, 5), ("maintenance request status", 3, 3)], "term string, n_tokens int, freq long")
    got = {r.term: r.score for r in R.c_value(terms).collect()}
    assert got == {"maintenance request": pytest.approx(3.1699250014423126, abs=1e-12), "maintenance request status": pytest.approx(6.0, abs=1e-12)}


TOKEN = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,idx:int>>"


def parsed(spark, *sentences):
    rows = [(n, [(i, w, w, p, d, h, 0) for i, (w, p, d, h) in enumerate(s)]) for n, s in enumerate(sentences)]
    return spark.createDataFrame(rows, f"sent_id long, tokens {TOKEN}")


def test_triples(spark):
    manages = [("owner", "NOUN", "nsubj", 1), ("manage", "VERB", "ROOT", 1), ("property", "NOUN", "dobj", 1)]
    copula = [("owner", "NOUN", "nsubj", 1), ("be", "AUX", "ROOT", 1), ("property", "NOUN", "attr", 1)]
    longest = [("vendor", "NOUN", "nsubj", 1), ("resolve", "VERB", "ROOT", 1), ("maintenance", "NOUN", "compound", 3), ("request", "NOUN", "dobj", 1)]
    classes = spark.createDataFrame([(x,) for x in ("owner", "property", "vendor", "request", "maintenance request")], "term string")
    got = {tuple(r)[:3] for r in R.triples(parsed(spark, manages, copula, longest), classes).collect()}
    assert got == {("owner", "manage", "property"), ("vendor", "resolve", "maintenance request")}
    assert {r.term for r in R.spans(parsed(spark, longest)).collect()} == {"vendor", "maintenance", "request", "maintenance request"}


def test_triples_of_many_classes(spark):
    manages = [("owner", "NOUN", "nsubj", 1), ("manage", "VERB", "ROOT", 1), ("property", "NOUN", "dobj", 1)]
    classes = spark.range(12_000).select(F.concat(F.lit("class "), "id").alias("term")).union(spark.createDataFrame([("owner",), ("property",)], "term string"))
    assert [tuple(r)[:3] for r in R.triples(parsed(spark, manages), classes).collect()] == [("owner", "manage", "property")]


def test_recovery():
    good = '{"classes": [{"name": "A {b} \\" c"}]}'
    for text in (good, "pre " + good + " post", 'decoy {"x": 1} then ' + good):
        found, error = I.recover(text)
        assert error is None and "A {b}" in found
    for text in ("", None, "prose", '{"unrelated": true}', "{broken"):
        assert I.recover(text)[0] is None


def test_clean(spark):
    rows = [("r", 0, "Owner", None, ["Size", "size", None]), ("r", 1, "  owner ", "Party", ["Hue"]), ("r", 2, "Landlord", None, []), ("r", 3, " ", None, []), ("r", 4, None, None, [])]
    got = {r.name: (r.parent, r.attributes) for r in I.clean_classes(spark.createDataFrame(rows, "id string, pos int, name string, parent string, attributes array<string>")).collect()}
    assert got == {"Owner": (None, ["Size", "Hue"]), "Landlord": (None, [])}
    rel = [("r", 0, "A", "has", "B"), ("r", 1, "a ", "HAS", "b"), ("r", 2, "A", "owns", "B"), ("r", 3, None, "x", "B")]
    assert I.clean_relations(spark.createDataFrame(rel, "id string, pos int, source string, label string, target string")).count() == 2


TTL = """@prefix : <http://x.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# a comment; with . signs
:Party a owl:Class . :Owner a owl:Class ; rdfs:subClassOf :Party ; rdfs:comment "it's; a . text" .
<http://x.org/o#Lease> a owl:Class .
:name a owl:DatatypeProperty ; rdfs:domain :Party . :lost a owl:DatatypeProperty .
:hasParty a owl:ObjectProperty ; rdfs:domain :Lease ; rdfs:range :Party .
:hasOwnerParty a owl:ObjectProperty ; rdfs:subPropertyOf :hasParty ; rdfs:domain :Lease ;
  rdfs:range :Owner .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TTL)
    classes, relations = readers.gold_schema(readers.read_turtle(spark, str(tmp_path / "g.ttl")))
    assert {r.name: (r.parent, r.attributes) for r in classes.collect()} == {"Party": (None, ["name"]), "Owner": ("Party", []), "Lease": (None, [])}
    assert [tuple(r) for r in relations.collect()] == [("Lease", "hasParty", "Owner")]


def scored(spark, gold, made):
    kind = "name string, parent string, attributes array<string>"
    g, i = spark.createDataFrame(gold, kind), spark.createDataFrame([("r", *x) for x in made], "run string, " + kind)
    side = lambda df: df.select(F.lit("r").alias("scope"), F.col("name").alias("id"), T.normalize(F.col("name")).alias("norm"))
    pairs = M.match_exact(side(g), side(i)).select(F.col("scope").alias("run"), "gold", "induced")
    runs = spark.createDataFrame([("r",)], "run string")
    return {f.__name__: tuple(f(g, i, pairs, runs).first()[2:5]) for f in (S.classes_layer, S.taxonomy_layer)}


def test_toy_layers(spark):
    gold = [("Party", None, ["a"]), ("Owner", "Party", []), ("Tenant", "Party", []), ("Lease", None, [])]
    assert scored(spark, gold, gold) == {"classes_layer": (4, 0, 0), "taxonomy_layer": (2, 0, 0)}
    assert scored(spark, gold, [(n, None, a) for n, _, a in gold])["taxonomy_layer"] == (0, 0, 2)
    assert scored(spark, gold, gold + [("Zoning Permit", None, [])])["classes_layer"] == (4, 1, 0)
    assert scored(spark, gold, gold[:1])["classes_layer"] == (1, 0, 3)


def test_reversed_relations(spark):
    rel = [("A", "owns", "B"), ("B", "in", "C"), ("C", "amends", "C")]
    gold = spark.createDataFrame(rel, "source string, label string, target string")
    made = spark.createDataFrame([("r", t, x, s) for s, x, t in rel], "run string, source string, label string, target string")
    pairs, runs = spark.createDataFrame([("r", x, x) for x in "ABC"], "run string, gold string, induced string"), spark.createDataFrame([("r",)], "run string")
    assert tuple(S.relations_layer(gold, made, pairs, runs).first()[2:5]) == (1, 2, 2)
    assert tuple(S.relations_layer(gold, made, pairs, runs, inverse=True).first()[2:5]) == (3, 0, 0)


def test_effective_attributes_stop_at_cycles_and_dangling(spark):
    rows = [("r", "A", "B", ["a"]), ("r", "B", "A", ["b"]), ("r", "Building", "Asset", ["x"])]
    got = S.effective_attributes(spark.createDataFrame(rows, "run string, name string, parent string, attributes array<string>"), spark)
    assert {r.name: r.attributes for r in got.collect()} == {"A": ["a", "b"], "B": ["a", "b"], "Building": ["x"]}


def test_a_chain_of_ancestors_has_no_last_step(spark):
    rows = [("r", f"c{k}", f"c{k - 1}" if k else None, [f"a{k}"]) for k in range(31)]
    got = S.effective_attributes(spark.createDataFrame(rows, "run string, name string, parent string, attributes array<string>"), spark)
    assert {r.name: len(r.attributes) for r in got.collect()}["c30"] == 31


def test_a_relation_found_both_ways_leaves_no_wrong_one(spark):
    gold = spark.createDataFrame([("A", "owns", "B")], "source string, label string, target string")
    made = spark.createDataFrame([("r", "A", "owns", "B"), ("r", "B", "owns", "A")], "run string, source string, label string, target string")
    pairs, runs = spark.createDataFrame([("r", x, x) for x in "AB"], "run string, gold string, induced string"), spark.createDataFrame([("r",), ("none",)], "run string")
    got = {(r.run, r.layer): tuple(r[2:]) for inverse in (False, True) for r in S.relations_layer(gold, made, pairs, runs, inverse).collect()}
    assert got["r", "relations"][:3] == (1, 1, 0) and got["r", "relations_allow_inverse"] == (1, 0, 0, 1.0, 1.0, 1.0)
    assert got["none", "relations"] == (0, 0, 1, 0.0, 0.0, 0.0)
    assert tuple(S.relations_layer(gold.limit(0), made, pairs, runs).where("run = 'r'").first())[2:] == (0, 2, 0, None, None, None)


def test_integrity_finds_planted_violations(spark, tmp_path):
    tables = {
        "customer": ("c_custkey long", [(1,), (10,), (101,)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 10), (3, 20), (4, 21), (5, None)]),
        "lineitem": ("l_orderkey long", [(1,), (2,), (2,), (9,)]),
        "events": ("user_id long", [(1,), (101,), (102,), (50,), (None,)]),
    }
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(map(tuple, Q.jn_integrity(spark, str(tmp_path)).collect()))
    assert got == [("line_order", "9"), ("order_customer", "20"), ("order_customer", "21"), ("twice", "2"), ("user", "102"), ("user", "50")]


def test_every_oracle_has_a_query():
    assert set(Q.ORACLES) <= set(Q.QUERIES)
