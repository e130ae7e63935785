"""Queries of the reference's operators over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from schemaloom.functions import text as T
from schemaloom.operators import annotate as A, fixtures as X, induced as I, instances as N, integrity as G, match as M, model_runs as U, score as S, terms as R
from schemaloom.sources import readers
from schemaloom.sources.tables import written
from schemaloom.streaming.events import tumbling_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL of the same rules, for the oracles.
_IRREGULAR = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.IRREGULAR.items())
_SINGULAR = _IRREGULAR + """ ELSE CASE WHEN length(t) <= 3 THEN t WHEN regexp_matches(t, '(ss|us|is)$') THEN t
 WHEN regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '(ss|x|zz|ch|sh)es$') THEN regexp_replace(t, 'es$', '')
 WHEN regexp_matches(t, 's$') THEN regexp_replace(t, 's$', '') ELSE t END END"""

# Plurals and what they have to become, written out, so that the rules above have something to be held against.
_PLURALS = """leases lease, expenses expense, licenses license, purchases purchase, houses house, databases database, movies movie, properties property, parties party, addresses address,
classes class, taxes tax, boxes box, branches branch, dishes dish, quizzes quiz, prizes prize, sizes size, buses bus, status status, analysis analysis, people person, children child, knives knife,
premises premise, cities city, keys key, shoes shoe, heroes hero, roofs roof, owners owner, lease lease, gas gas, as as, series series, caches cache, causes cause, responses response, invoices invoice"""
_PLURALS = [tuple(p.split()) for p in _PLURALS.replace("\n", " ").split(",")]


def _norm(x: str) -> str:
    spaced = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(lower({spaced}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: {_SINGULAR}), ' ')"


@query(f"SELECT p_partkey, {_norm('p_name')} AS norm, {_norm('p_type')} AS type_norm FROM part")
def str_normalize(spark, sf):
    """STR-1, STR-2"""
    return read(spark, sf, "part").select("p_partkey", T.normalize(F.col("p_name")).alias("norm"), T.normalize(F.col("p_type")).alias("type_norm"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PLURALS) + ") v(plural, singular)")
def str_singular(spark, sf):
    """STR-2 against written-out pairs"""
    words = spark.createDataFrame([(a,) for a, _ in _PLURALS], "plural string")
    return words.select("plural", T.singular(F.col("plural")).alias("singular"))


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS key, length(trim(c_name)) > 0 AS usable FROM customer")
def str_name_key(spark, sf):
    """STR-3, STR-4, STR-5"""
    return read(spark, sf, "customer").select("c_custkey", T.name_key(F.col("c_name")).alias("key"), T.usable(F.col("c_name")).alias("usable"))


@query("SELECT p_partkey, contains(' ' || lower(p_name) || ' ', ' ' || lower(p_type) || ' ') AS holds, contains(' ' || lower(p_type || ' ' || p_name) || ' ', ' ' || lower(p_name) || ' ') AS whole, round(log2(len(string_split(p_name, ' ')) + 1), 6) AS factor FROM part")
def str_contains_tokens(spark, sf):
    """STR-7, STR-8"""
    return read(spark, sf, "part").select("p_partkey", T.contains_tokens(F.lower("p_name"), F.lower("p_type")).alias("holds"), T.contains_tokens(F.lower(F.concat_ws(" ", "p_type", "p_name")), F.lower("p_name")).alias("whole"), F.round(T.length_factor(F.size(F.split("p_name", " "))), 6).alias("factor"))


@query("SELECT page_id, regexp_extract(url, '[^#/]*$') AS name FROM pages")
def src_local_name(spark, sf):
    """SRC-2"""
    return read(spark, sf, "pages").select("page_id", T.local_name(F.col("url")).alias("name"))


_RESPONSE = "CASE WHEN conv_id % 3 = 0 THEN '<think>x {' || role || '}</think> ' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'so:' || chr(10) || '```json' || chr(10) || '{\"turn\": ' || turn || '}' || chr(10) || '``` end' ELSE text END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_RESPONSE} AS x FROM conversations),
 s AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '(?is)<think\\b[^>]*>.*?</think>', '', 'g'), '(?is)^.*</think>', '')) AS x FROM r)
 SELECT conv_id, turn, CASE WHEN regexp_extract(x, '(?s)```[a-zA-Z0-9_-]*\\n(.*?)```', 1) <> '' THEN trim(regexp_extract(x, '(?s)```[a-zA-Z0-9_-]*\\n(.*?)```', 1), ' ') ELSE trim(x, ' ') END AS ready FROM s""")
def str_strip_response(spark, sf):
    """STR-9, STR-10"""
    c = read(spark, sf, "conversations").withColumn("x", F.expr(_RESPONSE))
    return c.select("conv_id", "turn", T.strip_fences(T.strip_reasoning(F.col("x"))).alias("ready"))


@query("SELECT o_orderkey, CAST(make_date(year(d), month(d), least(day(o_orderdate), 28)) AS VARCHAR) AS renewed, 'ord_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, CAST(CAST(o_orderdate AS DATE) + 21 AS VARCHAR) AS reported FROM (SELECT *, date_trunc('month', o_orderdate) + INTERVAL 12 MONTH AS d FROM orders)")
def dat_add_months(spark, sf):
    """DAT-2, DAT-3, FMT-1"""
    o = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", T.add_months_clamped(F.col("d"), 12).cast("string").alias("renewed"), T.padded_id("ord_", F.col("o_orderkey"), 8).alias("id"), F.date_add("d", 21).cast("string").alias("reported"))


_PRF = "tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp * 1.0 / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp * 1.0 / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1", "value", "score") else F.col(c) for c in df.columns])


@query(f"SELECT {_PRF} FROM (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS fn FROM labels)")
def agg_prf(spark, sf):
    """AGG-7"""
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    c = read(spark, sf, "labels").agg(n("quality = 1 and toxic = 1").alias("tp"), n("quality = 0 and toxic = 1").alias("fp"), n("quality = 1 and toxic = 0").alias("fn"))
    return _rounded(c.select(*S.prf(F.col("tp"), F.col("fp"), F.col("fn"))))


# Schemas made from the star schema: gold classes are the parts' types per brand, induced ones their names and the plurals of the types of large parts.
_M1 = f"""g AS (SELECT DISTINCT p_brand AS scope, p_type AS id, {_norm("p_type")} AS norm FROM part),
 i AS (SELECT DISTINCT p_brand AS scope, p_name AS id, {_norm("p_name")} AS norm FROM part UNION SELECT p_brand, p_type || 's', {_norm("p_type || 's'")} FROM part WHERE p_size > 25),
 m AS (SELECT a.scope, a.norm, a.id AS gold, b.id AS induced FROM (SELECT *, row_number() OVER (PARTITION BY scope, norm ORDER BY id) AS k FROM g) a JOIN (SELECT *, row_number() OVER (PARTITION BY scope, norm ORDER BY id) AS k FROM i) b USING (scope, norm, k))"""


def _sides(spark, sf):
    p = read(spark, sf, "part")
    side = lambda df, c: df.select(F.col("p_brand").alias("scope"), c.alias("id"), T.normalize(c).alias("norm"))
    plural = side(p.where("p_size > 25"), F.concat("p_type", F.lit("s")))
    return side(p, F.col("p_type")).distinct(), side(p, F.col("p_name")).union(plural).distinct()


@query(f"WITH {_M1} SELECT * FROM m")
def jn_match_exact(spark, sf):
    """SIM-1, JN-2 at M1, JN-3"""
    return M.match_exact(*_sides(spark, sf))


@query(f"WITH {_M1} SELECT 'gold' AS side, g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scope = g.scope AND m.gold = g.id) UNION ALL SELECT 'induced', i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scope = i.scope AND m.induced = i.id)")
def jn_unmatched(spark, sf):
    """JN-14"""
    g, i = _sides(spark, sf)
    m = M.match_exact(g, i)
    left = lambda side, name: M.unmatched(side, m, name).select(F.lit(name).alias("side"), "scope", "id", "norm")
    return left(g, "gold").union(left(i, "induced"))


# One gold schema (nations under regions) and an induced one per market segment (nations of its customers, under a region unless the key is even).
_SCHEMAS = """gc AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, NULL FROM region),
 ic AS (SELECT DISTINCT c_mktsegment AS run, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE r_name END AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, r_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 p AS (SELECT run, g.name AS gold, i.name AS induced FROM gc g JOIN ic i ON g.name = i.name), runs AS (SELECT DISTINCT run FROM ic)"""


def _schemas(spark, sf):
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    gold = n.select(F.col("n_name").alias("name"), F.col("r_name").alias("parent")).union(n.select("r_name", none)).distinct()
    c = read(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct().join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    made = c.select(F.col("c_mktsegment").alias("run"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, none).otherwise(F.col("r_name")).alias("parent"))
    made = made.union(c.select("c_mktsegment", "r_name", none)).distinct()
    attrs = lambda df: df.withColumn("attributes", F.array(F.substring("name", 1, 1), F.substring("name", 2, 2)))
    gold, made = attrs(gold), attrs(made)
    runs = made.select("run").distinct()
    return gold, made, S.class_pairs(gold, made, runs, "M1").select("run", "gold", "induced"), runs


def _layer(name: str, tp: str, gold: str, induced: str) -> str:
    return f"WITH {_SCHEMAS}, c AS (SELECT run, ({tp}) AS tp, ({gold}) AS ng, ({induced}) AS ni FROM runs r), d AS (SELECT run, tp, ni - tp AS fp, ng - tp AS fn FROM c) SELECT run, '{name}' AS layer, {_PRF} FROM d"


@query(_layer("classes", "SELECT count(*) FROM p WHERE p.run = r.run", "SELECT count(*) FROM gc", "SELECT count(*) FROM ic WHERE ic.run = r.run"))
def agg_classes_layer(spark, sf):
    """AGG-8"""
    gold, made, pairs, runs = _schemas(spark, sf)
    return _rounded(S.classes_layer(gold, made, pairs, runs))


@query(_layer("taxonomy", "SELECT count(*) FROM gc JOIN ic USING (name, parent) WHERE ic.run = r.run", "SELECT count(*) FROM gc WHERE parent IS NOT NULL", "SELECT count(*) FROM ic WHERE ic.run = r.run AND parent IS NOT NULL"))
def agg_taxonomy_layer(spark, sf):
    """AGG-9, JN-5"""
    gold, made, pairs, runs = _schemas(spark, sf)
    return _rounded(S.taxonomy_layer(gold, made, pairs, runs))


@query(f"""WITH {_SCHEMAS}, c AS (SELECT run, 2 * (SELECT count(*) FROM p WHERE p.run = r.run) AS tp, 2 * (SELECT count(*) FROM gc) AS ng FROM runs r),
 d AS (SELECT run, tp, 0::BIGINT AS fp, ng - tp AS fn, ng FROM c), e AS (SELECT run, {_PRF}, round(tp * 1.0 / ng, 6) AS macro FROM d)
 SELECT run, 'attributes_micro' AS layer, tp, fp, fn, precision, recall, f1 FROM e UNION ALL SELECT run, 'attributes_macro', tp, fp, fn, NULL, NULL, macro FROM e""")
def agg_attributes_layer(spark, sf):
    """AGG-10"""
    gold, made, pairs, runs = _schemas(spark, sf)
    return _rounded(S.attributes_layer(gold, made, pairs, runs, S.attribute_pairs(gold, made, pairs, "M1")))


_REL = """gr AS (SELECT n_name AS source, 'in' AS label, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey),
 ir AS (SELECT DISTINCT c_mktsegment AS run, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE n_name END AS source, CASE WHEN n_nationkey % 5 = 0 THEN 'near' ELSE 'in' END AS label, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _relations(spark, sf):
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    gold = n.select(F.col("n_name").alias("source"), F.lit("in").alias("label"), F.col("r_name").alias("target"))
    c = read(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct().join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    turned = F.col("n_nationkey") % 3 == 0
    made = c.select(F.col("c_mktsegment").alias("run"), F.when(turned, F.col("r_name")).otherwise(F.col("n_name")).alias("source"), F.when(F.col("n_nationkey") % 5 == 0, "near").otherwise("in").alias("label"), F.when(turned, F.col("n_name")).otherwise(F.col("r_name")).alias("target")).distinct()
    return gold, made


def _rel_oracle(name: str, tp: str) -> str:
    return _layer(name, tp, "SELECT count(*) FROM gr", "SELECT count(*) FROM ir WHERE ir.run = r.run").replace("runs AS (", f"{_REL}, runs AS (", 1)


@query(_rel_oracle("relations", "SELECT count(*) FROM ir JOIN gr USING (source, label, target) WHERE ir.run = r.run"))
def agg_relations_layer(spark, sf):
    """JN-6, AGG-11, SET-4"""
    gold, made = _relations(spark, sf)
    _, _, pairs, runs = _schemas(spark, sf)
    return _rounded(S.relations_layer(gold, made, pairs, runs))


@query(_rel_oracle("relations_allow_inverse", "SELECT count(*) FROM gr WHERE EXISTS (SELECT 1 FROM ir WHERE ir.run = r.run AND ir.label = gr.label AND ((ir.source = gr.source AND ir.target = gr.target) OR (ir.source = gr.target AND ir.target = gr.source)))"))
def agg_relations_inverse(spark, sf):
    """AGG-12, PRJ-8, SET-1..3"""
    gold, made = _relations(spark, sf)
    _, _, pairs, runs = _schemas(spark, sf)
    return _rounded(S.relations_layer(gold, made, pairs, runs, inverse=True))


@query(f"WITH {_SCHEMAS}, a AS (SELECT name, parent, [name[1:1], name[2:3]] AS attrs FROM gc) SELECT a.name, list_sort(list_distinct(list_concat(a.attrs, coalesce(b.attrs, [])))) AS attributes FROM a LEFT JOIN a b ON a.parent = b.name")
def agg_effective_attributes(spark, sf):
    """AGG-14, SET-5"""
    gold, *_ = _schemas(spark, sf)
    return S.effective_attributes(gold, spark, keys=()).select("name", "attributes")


@query(f"WITH x AS ({ORACLES['agg_classes_layer']}) UNPIVOT (SELECT run, 'M1' AS level, layer, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1 FROM x) ON tp, fp, fn, precision, recall, f1 INTO NAME metric VALUE value")
def prj_long_rows(spark, sf):
    """PRJ-6"""
    return S.long_rows(agg_classes_layer(spark, sf), "M1")


@query(f"SELECT run, 'M1' AS level, layer, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn FROM ({ORACLES['agg_classes_layer']})")
def agg_score_pivot(spark, sf):
    """AGG-16"""
    return S.pivot_rows(prj_long_rows(spark, sf))


_SENT = r"""b AS (SELECT doc_id, generate_subscripts(x, 1) AS bn, unnest(x) AS block FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS x FROM documents)),
 s0 AS (SELECT doc_id, bn, regexp_split_to_array(regexp_replace(trim(regexp_replace(block, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS y FROM b),
 s1 AS (SELECT doc_id, bn, generate_subscripts(y, 1) AS pn, unnest(y) AS sentence FROM s0),
 s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bn, pn) - 1 AS sent_no, sentence FROM s1 WHERE length(trim(sentence)) > 0)"""


@query(f"WITH {_SENT} SELECT doc_id, sent_no, sentence FROM s")
def src_sentences(spark, sf):
    """SRC-7"""
    return R.sentences(read(spark, sf, "documents"))


_TERMS = _SENT + r""", tk AS (SELECT doc_id, sent_no, list_filter(regexp_split_to_array(lower(sentence), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM s),
 sp AS (SELECT doc_id, sent_no, n, i, t FROM tk, range(1, 5) a(n), range(0, 100000) b(i) WHERE i + n <= len(t)),
 cand AS (SELECT doc_id, sent_no, i AS start, n AS n_tokens, array_to_string(t[i + 1:i + n], ' ') AS term FROM sp)"""
_TERMS = _TERMS.replace("range(0, 100000) b(i)", "LATERAL (SELECT unnest(range(0, len(t))) AS i) b")
_FREQ = _TERMS + ", f AS (SELECT term, n_tokens, count(*) AS freq FROM cand GROUP BY ALL HAVING count(*) >= 3)"
_CVAL = _FREQ + """, sub AS (SELECT DISTINCT f.term AS container, array_to_string(string_split(f.term, ' ')[i:i + n - 1], ' ') AS term, f.freq FROM f, range(1, 4) a(n), range(1, 5) b(i) WHERE n < f.n_tokens AND i + n - 1 <= f.n_tokens),
 nest AS (SELECT sub.term, container, sub.freq FROM sub JOIN f USING (term)),
 cv AS (SELECT f.term, f.n_tokens, f.freq, round(log2(f.n_tokens + 1) * (f.freq - coalesce(m, 0)), 6) AS score FROM f LEFT JOIN (SELECT term, avg(freq) AS m FROM nest GROUP BY term) USING (term))"""


@query(f"WITH {_FREQ} SELECT * FROM f")
def agg_term_frequency(spark, sf):
    """AGG-1 in n-gram mode, AGG-2"""
    return R.ngram_frequencies(read(spark, sf, "documents"))


@query(f"WITH {_CVAL} SELECT DISTINCT term, container FROM nest")
def jn_nesting(spark, sf):
    """JN-7"""
    return R.nesting(R.ngram_frequencies(read(spark, sf, "documents")), closed=True)


@query(f"WITH {_CVAL} SELECT * FROM cv")
def agg_c_value(spark, sf):
    """AGG-4"""
    return _rounded(R.c_value(written(R.ngram_frequencies(read(spark, sf, "documents")))))


@query(f"WITH {_CVAL} SELECT * FROM cv ORDER BY score DESC, term LIMIT 20")
def term_cvalue_top(spark, sf):
    """WIN-1; the flagship query"""
    return R.top_classes(_rounded(R.c_value(written(R.ngram_frequencies(read(spark, sf, "documents"))))))


@query(f"""WITH {_CVAL}, top AS (SELECT term FROM cv ORDER BY score DESC, term LIMIT 20),
 h AS (SELECT c.term AS class, a.term AS attr FROM cand c JOIN top ON top.term = c.term JOIN cand a ON a.doc_id = c.doc_id AND a.sent_no = c.sent_no AND a.start = c.start + c.n_tokens JOIN f ON f.term = a.term
  WHERE a.term NOT IN (SELECT term FROM top) AND NOT contains(' ' || a.term || ' ', ' ' || c.term || ' ')),
 n AS (SELECT class, attr, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 3)
 SELECT class, attr, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, attr) AS rank FROM n) WHERE rank <= 10""")
def agg_attributes(spark, sf):
    """JN-8, AGG-5, WIN-2 in n-gram mode"""
    d = read(spark, sf, "documents")
    f = written(R.ngram_frequencies(d))
    return R.ngram_attributes(d, R.top_classes(_rounded(R.c_value(f))), guards=f)


@query("SELECT key, arg_min(form, (-n, form)) AS form FROM (SELECT lower(trim(regexp_replace(w, '\\s+', ' ', 'g'))) AS key, w AS form, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) GROUP BY ALL) GROUP BY key")
def agg_surface_forms(spark, sf):
    """AGG-3"""
    words = read(spark, sf, "documents").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("w"))
    return R.surface_forms(words, "w")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, b.vec_id AS other, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.3")
def sim_cosine(spark, sf):
    """SIM-3: every vector whose id is divisible by 100 against all of its label."""
    e = read(spark, sf, "embeddings")
    parts = 16  # of every label, so that a frequent one is spread
    q = e.where("vec_id % 100 = 0").select("vec_id", "label", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    other = e.select(F.col("vec_id").alias("other"), "label", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    both = q.join(other, ["label", "part"]).where("vec_id <> other")
    return _rounded(both.withColumn("score", M.cosine(F.col("q"), F.col("embedding"))).where(F.col("score") >= 0.3).select("vec_id", "other", "score"))


@query("SELECT DISTINCT p_brand AS scope, p_name AS gold, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS induced, 1.0::DOUBLE AS score FROM part")
def jn_assign_fuzzy(spark, sf):
    """SIM-2, JN-1, JN-2 general, JN-4: names of each brand against the same names with their words turned round"""
    p = read(spark, sf, "part").select(F.col("p_brand").alias("scope"), "p_name").distinct()
    turned = F.array_join(F.reverse(F.split("p_name", " ")), "-")
    return M.match(p.select("scope", F.col("p_name").alias("id"), F.col("p_name").alias("name")), p.select("scope", turned.alias("id"), turned.alias("name")), "M2")


@query("SELECT id, name, attributes FROM (SELECT lower(p_brand) AS id, arg_min(p_name, p_partkey) AS name, list_sort(list_distinct(list(lower(p_type)))) AS attributes FROM part GROUP BY lower(p_brand), lower(p_name))")
def jsn_clean_classes(spark, sf):
    """JSN-2, WIN-4, SET-6"""
    p = read(spark, sf, "part").select(F.lower("p_brand").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.array(F.lower("p_type")).alias("attributes"))
    return I.clean_classes(p).select("id", "name", F.array_sort("attributes").alias("attributes"))


@query("SELECT id, first AS pos, name, p_type FROM (SELECT p_brand AS id, p_name AS name, p_type, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS first, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def win_last_wins(spark, sf):
    """SRC-3, WIN-5"""
    return I.last_wins(read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), "p_type"))


@query("SELECT conv_id || ':' || turn AS id, text AS name, NULL::VARCHAR AS error FROM conversations")
def jsn_recover(spark, sf):
    """STR-11, JSN-1: schemas inside free text, with any text as a name."""
    c = read(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.lit('Here {is} it: {"classes": [{"name": '), F.to_json(F.struct("text")), F.lit("}]} done")).alias("response"))
    return I.parse_responses(c).select("id", F.get_json_object("schema_json", "$.classes[0].name.text").alias("name"), "error")


@query("SELECT id, arg_min(source, pos) AS source, arg_min(label, pos) AS label, arg_min(target, pos) AS target FROM (SELECT p_brand AS id, p_partkey AS pos, p_name AS source, CASE WHEN p_size % 2 = 0 THEN p_type ELSE lower(p_type) END AS label, p_type AS target FROM part) GROUP BY id, lower(source), lower(label), lower(target)")
def jsn_clean_relations(spark, sf):
    """JSN-2, SET-6: relations once each, whatever their case"""
    p = read(spark, sf, "part")
    label = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    rows = p.select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("source"), label.alias("label"), F.col("p_type").alias("target"))
    return I.clean_relations(rows).select("id", "source", "label", "target")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 15 AS batch FROM customer")
def win_chunks(spark, sf):
    """WIN-8: consecutive batches of fifteen"""
    return N.batches(read(spark, sf, "customer").select("c_custkey"), "c_custkey", 15)


@query("SELECT count(DISTINCT p_type) AS n, count(DISTINCT p_type) FILTER (p_type < 'M') AS known, count(DISTINCT p_type) FILTER (p_type >= 'M') AS fresh FROM part")
def sim_embed_cache(spark, sf):
    """SIM-4, SRC-12, SNK-5: vectors of the types, of which the cache has some under this model and all under another"""
    names = read(spark, sf, "part").select(F.col("p_type").alias("norm")).distinct()
    row = lambda df, version: df.select(F.lit("m").alias("model_name"), F.lit(version).alias("model_version"), "norm", F.array(F.lit(1.0)).alias("vector"))
    vectors, fresh = M.embed(names, row(names.where("norm < 'M'"), "2").union(row(names, "1")), lambda n: [0.0], "m", "2")
    n = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vector")[0] == 1.0).alias("known"))
    return n.withColumn("_one", F.lit(1)).join(fresh.agg(F.count("*").alias("fresh")).withColumn("_one", F.lit(1)), "_one").select("n", "known", "fresh")


@query("SELECT doc_id, source, round, row_number() OVER (ORDER BY round, source) - 1 AS ord FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents) WHERE round <= 15")
def win_round_robin(spark, sf):
    """SRC-8, SRC-9, WIN-6, WIN-7"""
    d = read(spark, sf, "documents").select("doc_id", "source")
    return readers.interleave(d, "source", "doc_id", "source", 15).select("doc_id", "source", F.col("round").cast("long").alias("round"), "ord")


@query("SELECT ord // 15 AS batch, CAST(sum(length('### ' || p_name || chr(10) || trim(p_type))) + 2 * (count(*) - 1) + 7 AS BIGINT) AS n_chars, count(*) AS n FROM (SELECT *, p_partkey AS ord FROM part) GROUP BY 1")
def prj_prompts(spark, sf):
    """PRJ-1, WIN-8, UDF-8"""
    d = read(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("text"))
    made = I.render_prompts(d, "Docs: \n{documents}", 15)
    n = d.groupBy(F.floor(F.col("ord") / 15).alias("batch")).agg(F.count("*").alias("n"))
    return made.join(n, "batch").select("batch", F.col("n_chars").cast("long").alias("n_chars"), "n")


@query("SELECT 'order_customer' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line_order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'twice', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def jn_integrity(spark, sf):
    """JN-12, AGG-19"""
    c, o, li, e = (read(spark, sf, t) for t in ("customer", "orders", "lineitem", "events"))
    return (
        G.missing_keys(o, "o_custkey", c, "c_custkey", "order_customer")
        .union(G.missing_keys(li, "l_orderkey", o, "o_orderkey", "line_order"))
        .union(G.missing_keys(e, "user_id", c, "c_custkey", "user"))
        .union(G.duplicate_keys(li, "l_orderkey", "twice"))
    )


@query("SELECT o_orderkey, c_name, n_name, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS renewed_by FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def jn_denormalise(spark, sf):
    """JN-11, WIN-10"""
    o = read(spark, sf, "orders").withColumn("renewed_by", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    c = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "renewed_by")


@query("SELECT event_type, count(*) FILTER (o = 'low') AS low, count(*) FILTER (o = 'mid') AS mid, count(*) FILTER (o = 'high') AS high, count(*) AS total FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 3 = 1 THEN 'mid' ELSE 'high' END AS o FROM events) GROUP BY event_type")
def agg_outcomes(spark, sf):
    """AGG-15"""
    e = read(spark, sf, "events").withColumn("o", F.expr("CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 3 = 1 THEN 'mid' ELSE 'high' END"))
    return G.outcome_counts(e, "event_type", "o", ["low", "mid", "high"])


@query("SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY source")
def agg_density(spark, sf):
    """AGG-18"""
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY event_type")
def src_latest(spark, sf):
    """SRC-13"""
    return read(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


_GRAMS = "SELECT {id}, array_to_string(t[i + 1:i + 8], ' ') AS g FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {table}), LATERAL (SELECT unnest(range(0, len(t) - 7)) AS i)"


@query(f"WITH d AS (SELECT DISTINCT * FROM ({_GRAMS.format(id='doc_id', table='documents')})), b AS (SELECT DISTINCT * FROM ({_GRAMS.format(id='item_id', table='benchmark')})) SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (g) GROUP BY ALL")
def set_leakage(spark, sf):
    """SET-7: runs of eight tokens that a document shares with a benchmark item"""
    def grams(table, key):
        t = read(spark, sf, table).select(key, F.expr(r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), x -> x <> '')").alias("t")).where("size(t) >= 8")
        return t.select(key, F.explode(F.expr("transform(sequence(0, size(t) - 8), i -> array_join(slice(t, i + 1, 8), ' '))")).alias("g"))

    # The runs of the documents meet the benchmark's first; what is left is made distinct.
    shared = grams("documents", "doc_id").join(grams("benchmark", "item_id").distinct(), "g").distinct()
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    """Streaming extension on a batch"""
    return tumbling_counts(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("SELECT * FROM (VALUES ('owners', 18, 18), ('agents', 14, 14), ('vendors', 12, 12), ('properties', 45, 45), ('tenants', 35, 35), ('maintenance_requests', 65, 65), ('violations', 0, 0)) v(name, n, ids)")
def src_generate(spark, sf):
    """SRC-14, DAT-1, FMT-1, JN-12, JN-13: tables with consistent keys, and their violations (none)"""
    t = N.generate(spark)
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"), F.count_distinct("id").cast("int").alias("ids"))
    out = count("violations", N.verify(t).withColumnRenamed("key", "id"))
    for name, df in t.items():
        if name != "leases":  # as many as the seed makes
            out = out.union(count(name, df))
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"('{lv}', '{t}', {c}, {x}, {r}, {i})" for lv in ("M1", "M2") for t, c, x, r, i in (("identity", "4, 0, 0", "2, 0, 0", "3, 0, 0", "3, 0, 0"), ("added", "4, 2, 0", "2, 0, 0", "3, 0, 0", "3, 0, 0"), ("flat", "4, 0, 0", "0, 0, 2", "3, 0, 0", "3, 0, 0"), ("half", "2, 0, 2", "0, 1, 2", "2, 0, 1", "2, 0, 1"), ("reversed", "4, 0, 0", "2, 0, 0", "1, 2, 2", "3, 0, 0"))) + ") v(level, run, c_tp, c_fp, c_fn, t_tp, t_fp, t_fn, r_tp, r_fp, r_fn, i_tp, i_fp, i_fn)")
def score_schemas(spark, sf):
    """AGG-13, PRJ-9, UDF-11, WIN-11: toy schemas with one fault each, scored on all layers at two levels"""
    c = spark.createDataFrame([("Party", None, ["name"]), ("Owner", "Party", ["share"]), ("Tenant", "Party", []), ("Lease", None, ["rent", "term"])], "name string, parent string, attributes array<string>")
    r = spark.createDataFrame([("Owner", "signs", "Lease"), ("Tenant", "rents under", "Lease"), ("Lease", "amends", "Lease")], "source string, label string, target string")
    gold = (c, r)
    toys = {"identity": gold, "added": X.add_classes(gold, ["Zoning Permit", "Utility Bill"]), "flat": X.flatten(gold), "half": X.keep_half(gold), "reversed": X.reverse(gold)}
    made = [X.as_run(s, n) for n, s in toys.items()]
    classes, relations = made[0]
    for a, b in made[1:]:
        classes, relations = classes.union(a), relations.union(b)
    runs = spark.createDataFrame([(n,) for n in toys], "run string")
    scores, _ = S.score_schema(gold, (classes, relations), runs, ("M1", "M2"), inverse=True)
    short = {"classes": "c", "taxonomy": "t", "relations": "r", "relations_allow_inverse": "i"}
    cells = [F.max(F.when(F.col("layer") == layer, F.col(m))).cast("int").alias(f"{k}_{m}") for layer, k in short.items() for m in ("tp", "fp", "fn")]
    return scores.groupBy("level", "run").agg(*cells)


@query(f"WITH {_SCHEMAS} SELECT run, CAST(count(*) AS INT) AS n_classes, CAST(2 * count(*) AS INT) AS n_attributes, 0 AS n_relations FROM ic GROUP BY run")
def agg_sizes(spark, sf):
    """AGG-17: sizes of the schemas of the market segments"""
    _, made, _, runs = _schemas(spark, sf)
    full = S.schema_sizes(made, spark.createDataFrame([], "run string, source string, label string, target string"), runs)
    return full.select("run", *[F.col(c).cast("int").alias(c) for c in ("n_classes", "n_attributes", "n_relations")])


_CORPUS = [
    "The owner's address is known.", "The Owner's address changed.", "Each owner's address is old.", "Owner: phone", "owner: phone", "Owner: phone",
    "the start date of the lease", "The start date of a lease", "start date of lease", "The owner signs the lease.", "An owner signs the lease.", "The owner signs a lease.",
]


@query("SELECT * FROM (VALUES ('class', 'owner', 'address,phone'), ('class', 'lease', 'start date,date'), ('relation', 'owner sign lease', NULL)) v(kind, name, attributes)")
def induce_schema(spark, sf):
    """UDF-1, UDF-9, STR-6, JN-8, JN-9, JN-10, AGG-6, WIN-3: a written-out corpus, tagged and induced; its two named classes"""
    sents = spark.createDataFrame(list(enumerate(_CORPUS)), "sent_id long, sentence string")
    tagged = written(A.annotate(sents))
    top = spark.createDataFrame([("owner",), ("lease",)], "term string")
    terms = R.frequencies(R.spans(tagged))
    attrs = R.capped(R.grammar_attributes(tagged, top, terms))
    attrs = attrs.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), F.length("attr") * -1, "attr"))), lambda x: x["attr"]), ",").alias("attributes"))
    rel = R.triples(tagged, top, 3).select(F.lit("relation").alias("kind"), F.concat_ws(" ", "subj", "verb", "obj").alias("name"), F.lit(None).cast("string").alias("attributes"))
    return attrs.select(F.lit("class").alias("kind"), F.col("class").alias("name"), "attributes").union(rel)


@query("SELECT c_custkey, round(c_acctbal, 2) AS v, CASE WHEN c_custkey % 7 = 0 THEN 'refused' WHEN c_custkey % 5 = 0 THEN 'truncated' WHEN c_custkey % 3 = 0 THEN 'empty' END AS error_kind FROM customer")
def prj_responses(spark, sf):
    """PRJ-10, PRJ-11, UDF-3: requests answered by a stub; refusals, cuts and blanks told apart"""
    def client(request):
        k = int(request["messages"][0]["content"].split()[-1])
        stop = "refusal" if k % 7 == 0 else "max_tokens" if k % 5 == 0 else "end_turn"
        return {"content": [{"type": "text", "text": " " if k % 3 == 0 else "ok"}], "stop_reason": stop, "usage": {"output_tokens": 1}}

    c = read(spark, sf, "customer")
    asked = U.call(c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer "), "c_custkey").alias("prompt")), U.Model("stub", "stub-1"), client)
    return c.select("c_custkey", F.round("c_acctbal", 2).alias("v")).join(asked.select(F.col("id").alias("c_custkey"), "error_kind"), "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'type,size' || chr(13) || chr(10) || p_type || ',' || p_size || chr(13) || chr(10) END AS csv, CASE WHEN p_partkey % 3 = 0 THEN '1 rows without 2 cells, the first: [0]' END AS error FROM part")
def snk_json_to_csv(spark, sf):
    """SNK-6: CSV from JSON tables, with the reason where a table is not one"""
    row = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_type"))).otherwise(F.array(F.col("p_type"), F.col("p_size").cast("string")))
    text = F.to_json(F.struct(F.array(F.lit("type"), F.lit("size")).alias("columns"), F.array(row).alias("rows")))
    made = N.tables_from_json(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("```json\n"), text, F.lit("\n```")).alias("response")))
    return made.select(F.col("id").alias("p_partkey"), "csv", "error")
