"""Precision, recall and F1 on the four layers of a schema, for many runs at once.

Schemas are two tables: classes(run, name, parent, attributes array<string>) and relations(run, source, label,
target). The gold schema has the same columns without ``run``. ``pairs`` are matched classes (run, gold, induced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from schemaloom.operators.match import Pack, match
from schemaloom.sources.tables import written

#: Between the parts of a scope's name.
SEP = "\x01"


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """tp, fp, fn, precision, recall, f1; a zero denominator gives 0.0."""
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def layer(counts: DataFrame, name: str) -> DataFrame:
    """(run, layer, tp, fp, fn, precision, recall, f1) from (run, tp, n_gold, n_induced and, if it differs from
    n_induced - tp, fp). Without anything in gold the layer doesn't apply: the ratios are null."""
    tp, fn = F.col("tp"), F.col("n_gold") - F.col("tp")
    fp = F.col("fp") if "fp" in counts.columns else F.col("n_induced") - F.col("tp")
    made = counts.select("run", "n_gold", F.lit(name).alias("layer"), *prf(tp, fp, fn))
    known = lambda c: F.when(F.col("n_gold") > 0, F.col(c)).alias(c)
    return made.select("run", "layer", "tp", "fp", "fn", *map(known, ("precision", "recall", "f1")))


def _with(runs: DataFrame, one: DataFrame) -> DataFrame:
    """Every run beside the single row of ``one``, by an equi-join; Spark chooses how, by size."""
    return runs.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _counts(tp: DataFrame, gold: DataFrame, induced: DataFrame, runs: DataFrame) -> DataFrame:
    n = gold.agg(F.count("*").alias("n_gold"))
    out = runs.join(induced.groupBy("run").agg(F.count("*").alias("n_induced")), "run", "left").join(tp.groupBy("run").agg(F.count("*").alias("tp")), "run", "left")
    return _with(out, n).select("run", F.coalesce("tp", F.lit(0)).alias("tp"), "n_gold", F.coalesce("n_induced", F.lit(0)).alias("n_induced"))


def classes_layer(gold: DataFrame, induced: DataFrame, pairs: DataFrame, runs: DataFrame) -> DataFrame:
    return layer(_counts(pairs, gold, induced, runs), "classes")


def taxonomy_layer(gold: DataFrame, induced: DataFrame, pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges with a parent; right if both ends are matched and the induced child's parent is the matched parent's own name."""
    edges, made = gold.where("parent is not null").select("name", "parent"), induced.where("parent is not null").select("run", "name", "parent")
    child = pairs.select("run", F.col("gold").alias("name"), F.col("induced").alias("child"))
    above = pairs.select("run", F.col("gold").alias("parent"), F.col("induced").alias("wanted"))
    right = edges.join(child, "name").join(above, ["run", "parent"]).select("run", "child", "wanted")
    right = right.join(made.select("run", F.col("name").alias("child"), F.col("parent").alias("wanted")), ["run", "child", "wanted"], "left_semi")
    return layer(_counts(right, edges, made, runs), "taxonomy")


def attributes_layer(gold: DataFrame, induced: DataFrame, pairs: DataFrame, runs: DataFrame, attr_pairs: DataFrame, name: str = "attributes") -> DataFrame:
    """Micro counts over matched classes, and macro F1 as the mean over all gold classes.

    attr_pairs: (run, gold_class, gold, induced), matched inside each matched class. An unmatched gold class gives all its
    attributes as misses and F1 0; attributes of unmatched induced classes count nowhere."""
    g = gold.select(F.col("name").alias("gold"), F.size("attributes").alias("n_gold"))
    i = induced.select("run", F.col("name").alias("induced"), F.size("attributes").alias("n_induced"))
    hit = attr_pairs.groupBy("run", F.col("gold_class").alias("gold")).agg(F.count("*").alias("tp"))
    per = _with(runs, g).join(pairs, ["run", "gold"], "left").join(i, ["run", "induced"], "left").join(hit, ["run", "gold"], "left")
    per = per.select("run", F.coalesce("tp", F.lit(0)).alias("tp"), "n_gold", F.coalesce("n_induced", F.lit(0)).alias("n_induced"))
    f1 = F.when(F.col("n_gold") + F.col("n_induced") > 0, 2 * F.col("tp") / F.nullif(F.col("n_gold") + F.col("n_induced"), F.lit(0))).otherwise(0.0)
    sums = per.groupBy("run").agg(F.sum("tp").alias("tp"), F.sum("n_gold").alias("n_gold"), F.sum("n_induced").alias("n_induced"), F.avg(f1).alias("macro"))
    micro = layer(sums, f"{name}_micro")
    ratio = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)  # noqa: E731  this layer always applies
    micro = micro.select("run", "layer", "tp", "fp", "fn", *map(ratio, ("precision", "recall", "f1")))
    macro = micro.join(sums.select("run", "macro"), "run").select("run", F.lit(f"{name}_macro").alias("layer"), "tp", "fp", "fn", F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), F.col("macro").alias("f1"))
    return micro.union(macro)


def resolve_relations(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gold relations with both ends renamed to their induced classes: (run, source, label, target); unresolved ends are dropped."""
    one = pairs.select("run", F.col("gold").alias("source"), F.col("induced").alias("s"))
    two = pairs.select("run", F.col("gold").alias("target"), F.col("induced").alias("t"))
    return relations.join(one, "source").join(two, ["run", "target"]).select("run", F.col("s").alias("source"), "label", F.col("t").alias("target"))


def relation_pairs(gold: DataFrame, induced: DataFrame, pairs: DataFrame, level: str = "M1", pack: Pack = Pack(), vectors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """(run, source, target, gold, induced): labels matched one to one among the relations between the same two matched classes."""
    scope = F.concat_ws(SEP, "run", "source", "target").alias("scope")
    side = lambda df: df.select(scope, F.col("label").alias("id"), F.col("label").alias("name")).distinct()
    found = match(side(resolve_relations(gold, pairs)), side(induced), level, pack, vectors, masked)
    part = F.split("scope", SEP)
    return found.select(part[0].alias("run"), part[1].alias("source"), part[2].alias("target"), "gold", "induced")


def relations_layer(gold: DataFrame, induced: DataFrame, pairs: DataFrame, runs: DataFrame, inverse: bool = False, level: str = "M1", pack: Pack = Pack(), vectors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """Labels of a level between matched ends. With ``inverse`` a gold relation is found if it matches in either direction,
    and an induced one is wrong only if it matches in neither."""
    gold, induced = gold.distinct(), induced.select("run", "source", "label", "target").distinct()
    hits = relation_pairs(gold, induced, pairs, level, pack, vectors, masked)
    if inverse:
        turned = induced.select("run", F.col("target").alias("source"), "label", F.col("source").alias("target"))
        back = relation_pairs(gold, turned, pairs, level, pack, vectors, masked)
        right = hits.select("run", "source", "target", "gold").union(back.select("run", "source", "target", "gold")).distinct()
        used = hits.select("run", "source", "target", "induced").union(back.select("run", F.col("target"), F.col("source"), "induced")).distinct()
    else:
        right = used = hits
    n = lambda df, c: df.groupBy("run").agg(F.count("*").alias(c))
    out = runs.join(n(right, "tp"), "run", "left").join(n(used, "used"), "run", "left").join(n(induced, "n_induced"), "run", "left").fillna(0, ["tp", "used", "n_induced"])
    out = _with(out, gold.agg(F.count("*").alias("n_gold"))).withColumn("fp", F.col("n_induced") - F.col("used"))
    return layer(out, "relations_allow_inverse" if inverse else "relations")


def effective_attributes(classes: DataFrame, spark, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """classes with the attributes of all ancestors added; a dangling parent or a cycle ends the walk. One step up for all
    classes at a time, each step written, until no class has a further ancestor."""
    known = classes.select(*keys, F.col("name").alias("up"), F.col("parent").alias("next"), F.col("attributes").alias("more"))
    walk = classes.select(*keys, "name", F.col("parent").alias("up"), F.array("name").alias("seen"), F.col("attributes").alias("attrs"))
    found = walk.select(*keys, "name", "attrs")
    while True:
        walk = walk.where("up is not null and not array_contains(seen, up)").join(known, [*keys, "up"])
        walk = written(walk.select(*keys, "name", F.col("next").alias("up"), F.concat("seen", F.array("up")).alias("seen"), F.col("more").alias("attrs")))
        if walk.isEmpty():
            break
        found = found.union(walk.select(*keys, "name", "attrs"))
    all_of = found.groupBy(*keys, "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("attrs")))).alias("attributes"))
    return classes.drop("attributes").join(all_of, [*keys, "name"])


def attribute_pairs(gold: DataFrame, induced: DataFrame, pairs: DataFrame, level: str, pack: Pack = Pack(), vectors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """(run, gold_class, gold, induced): attributes matched one to one inside each matched class pair."""
    scope = F.concat_ws(SEP, "run", "gold_class").alias("scope")
    of = pairs.select("run", F.col("gold").alias("gold_class"), F.col("induced").alias("induced_class"))
    left = of.join(gold.select(F.col("name").alias("gold_class"), F.explode("attributes").alias("id")), "gold_class")
    right = of.join(induced.select("run", F.col("name").alias("induced_class"), F.explode("attributes").alias("id")), ["run", "induced_class"])
    side = lambda df: df.select(scope, "id", F.col("id").alias("name")).distinct()
    part = F.split("scope", SEP)
    return match(side(left), side(right), level, pack, vectors, masked).select(part[0].alias("run"), part[1].alias("gold_class"), "gold", "induced")


def class_pairs(gold: DataFrame, induced: DataFrame, runs: DataFrame, level: str, pack: Pack = Pack(), vectors: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """(run, gold, induced, score): classes matched one to one by name inside each run."""
    left = _with(runs, gold.select("name")).select(F.col("run").alias("scope"), F.col("name").alias("id"), "name")
    right = induced.select(F.col("run").alias("scope"), F.col("name").alias("id"), "name")
    return match(left, right, level, pack, vectors, masked).withColumnRenamed("scope", "run")


def names_of(*tables: DataFrame) -> DataFrame:
    """(norm): every name, attribute and label of classes or relations, normalised, for the embedder."""
    from schemaloom.functions.text import normalize

    parts = []
    for t in tables:
        parts += [t.select("name"), t.select(F.explode("attributes").alias("name"))] if "attributes" in t.columns else [t.select(F.col("label").alias("name"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select(normalize(F.col("name")).alias("norm")).distinct()


def score_schema(gold: tuple[DataFrame, DataFrame], induced: tuple[DataFrame, DataFrame], runs: DataFrame, levels: tuple[str, ...] = ("M1", "M2", "M3"), pack: Pack = Pack(), vectors: DataFrame | None = None, inverse: bool = False, masked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, decisions) of all runs at all levels.

    gold and induced are (classes, relations); an induced class has one row for each run and name. scores(run, level,
    layer, tp, fp, fn, precision, recall, f1, n_a); decisions(run, level, gold, induced, score) are the matched classes.
    Each level stands for itself; all layers of a level rest on its class matches. ``inverse`` adds relations in either
    direction, ``masked`` sets scores under the threshold to zero before the assignment."""
    (gold_classes, gold_relations), (classes, relations) = gold, induced
    spark = runs.sparkSession
    gold_all, all_ = written(effective_attributes(gold_classes, spark, keys=())), written(effective_attributes(classes, spark))
    scores, decisions = [], []
    for level in levels:
        how = (level, pack, vectors, masked)
        found = written(class_pairs(gold_classes, classes, runs, *how))
        decisions.append(found.select("run", F.lit(level).alias("level"), "gold", "induced", "score"))
        pairs = found.select("run", "gold", "induced")
        layers = [classes_layer(gold_classes, classes, pairs, runs), taxonomy_layer(gold_classes, classes, pairs, runs)]
        for kind, g, i in (("effective", gold_all, all_), ("declared", gold_classes, classes)):
            layers.append(attributes_layer(g, i, pairs, runs, attribute_pairs(g, i, pairs, *how), f"attributes_{kind}"))
        layers.append(relations_layer(gold_relations, relations, pairs, runs, False, *how))
        if inverse:
            layers.append(relations_layer(gold_relations, relations, pairs, runs, True, *how))
        for x in layers:  # each a row per run; written one by one, as one plan of them all is slow to optimise
            scores.append(written(x.select("run", F.lit(level).alias("level"), *x.columns[1:], F.col("f1").isNull().alias("n_a"))))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(scores), union(decisions)


def decision_documents(decisions: DataFrame, gold_classes: DataFrame, classes: DataFrame, runs: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(run, level, document): the class matches of a run and level with what is left on both sides, as one JSON text."""
    per = _with(runs, runs.sparkSession.createDataFrame([(x,) for x in levels], "level string"))
    pair = F.struct("gold", "induced", "score")
    got = decisions.groupBy("run", "level").agg(F.array_sort(F.collect_list(pair)).alias("classes_matched"))
    rest = lambda side, c: _with(per, side).join(decisions.select("run", "level", F.col(c).alias("name")), ["run", "level", "name"], "left_anti").groupBy("run", "level").agg(F.array_sort(F.collect_list("name")).alias(f"classes_unmatched_{c}"))
    made = per.join(classes.select("run", "name"), "run")
    spare = made.join(decisions.select("run", "level", F.col("induced").alias("name")), ["run", "level", "name"], "left_anti").groupBy("run", "level").agg(F.array_sort(F.collect_list("name")).alias("classes_unmatched_induced"))
    out = per.join(got, ["run", "level"], "left").join(rest(gold_classes.select("name"), "gold"), ["run", "level"], "left").join(spare, ["run", "level"], "left")
    none = F.array().cast("array<string>")
    document = F.struct("level", F.coalesce("classes_matched", F.array().cast(got.schema["classes_matched"].dataType)).alias("classes_matched"), F.coalesce("classes_unmatched_gold", none).alias("classes_unmatched_gold"), F.coalesce("classes_unmatched_induced", none).alias("classes_unmatched_induced"))
    return out.select("run", "level", F.to_json(document).alias("document"))


def schema_sizes(classes: DataFrame, relations: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, n_classes, n_attributes, n_relations) of each run."""
    c = classes.groupBy("run").agg(F.count("*").alias("n_classes"), F.sum(F.size("attributes")).alias("n_attributes"))
    r = relations.groupBy("run").agg(F.count("*").alias("n_relations"))
    return runs.join(c, "run", "left").join(r, "run", "left").fillna(0, ["n_classes", "n_attributes", "n_relations"])


def mismatches(gold: tuple[DataFrame, DataFrame], induced: tuple[DataFrame, DataFrame], decisions: DataFrame, runs: DataFrame, level: str, pack: Pack = Pack(), vectors: DataFrame | None = None) -> DataFrame:
    """(run, layer, kind, gold, induced, reason) of what a level counts as missing or spurious: missing and spurious
    classes, split classes (a spurious class that would match one that is taken), flattened taxonomy, missing attributes,
    reversed relations and other missing ones."""
    (gold_classes, gold_relations), (classes, relations) = gold, induced
    pairs = decisions.where(F.col("level") == level).select("run", "gold", "induced")
    text = lambda x: F.lit(x)
    row = lambda df, layer, kind, g, i, reason: df.select("run", text(layer).alias("layer"), text(kind).alias("kind"), g.cast("string").alias("gold"), i.cast("string").alias("induced"), text(reason).alias("reason"))
    none = F.lit(None)
    missed = _with(runs, gold_classes.select(F.col("name").alias("gold"))).join(pairs, ["run", "gold"], "left_anti")
    spare = classes.select("run", F.col("name").alias("induced")).join(pairs, ["run", "induced"], "left_anti")
    taken = pairs.select(F.col("run").alias("scope"), F.col("gold").alias("id"), F.col("gold").alias("name"))
    again = match(taken, spare.select(F.col("run").alias("scope"), F.col("induced").alias("id"), F.col("induced").alias("name")), level, pack, vectors).select(F.col("scope").alias("run"), "gold", "induced")
    above = gold_classes.where("parent is not null").select(F.col("name").alias("gold"))
    flat = pairs.join(above, "gold").join(classes.where("parent is null").select("run", F.col("name").alias("induced")), ["run", "induced"])
    attrs = pairs.withColumnRenamed("gold", "gold_class").join(gold_classes.select(F.col("name").alias("gold_class"), F.explode("attributes").alias("gold")), "gold_class")
    attrs = attrs.join(attribute_pairs(gold_classes, classes, pairs, level, pack, vectors).select("run", "gold_class", "gold"), ["run", "gold_class", "gold"], "left_anti")
    wanted = resolve_relations(gold_relations, pairs).distinct()
    here = relation_pairs(gold_relations, relations, pairs, level, pack, vectors).select("run", "source", "target", F.col("gold").alias("label"))
    turned = relations.select("run", F.col("target").alias("source"), "label", F.col("source").alias("target"))
    back = relation_pairs(gold_relations, turned, pairs, level, pack, vectors).select("run", "source", "target", F.col("gold").alias("label"))
    lost = wanted.join(here, ["run", "source", "target", "label"], "left_anti")
    shown = F.concat_ws(" ", "source", "label", "target")
    out = [
        row(missed, "classes", "missing_class", F.col("gold"), none, "no induced class matches"),
        row(spare.join(again, ["run", "induced"], "left_anti"), "classes", "spurious_class", none, F.col("induced"), "matches no gold class"),
        row(again, "classes", "split_class", F.col("gold"), F.col("induced"), "matches a gold class that another induced class has"),
        row(flat, "taxonomy", "flattened_taxonomy", F.col("gold"), F.col("induced"), "the gold class has a parent, the induced one none"),
        row(attrs, "attributes", "missing_attribute", F.concat_ws(".", "gold_class", "gold"), F.col("induced"), "the matched class lacks it"),
        row(lost.join(back, ["run", "source", "target", "label"], "left_semi"), "relations", "reversed_relation", shown, none, "matches with its ends exchanged"),
        row(lost.join(back, ["run", "source", "target", "label"], "left_anti"), "relations", "missing_relation", shown, none, "no label between the matched ends matches"),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(out)


def sample_decisions(decisions: DataFrame, level: str = "M3", n: int = 100, seed: int = 42) -> DataFrame:
    """A seeded sample of a level's decisions for checking by hand; the same rows wherever it runs."""
    picked = decisions.where(F.col("level") == level).withColumn("_at", F.xxhash64(F.lit(seed), "run", "gold", "induced"))
    return picked.orderBy("_at", "run", "gold", "induced").limit(n).drop("_at")


def long_rows(scores: DataFrame, level) -> DataFrame:
    """One row per metric: run, level, layer, metric, value; ``level`` is a name or a column."""
    wide = scores.select("run", F.lit(level).alias("level") if isinstance(level, str) else level, "layer", *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1")])
    return wide.unpivot(["run", "level", "layer"], ["tp", "fp", "fn", "precision", "recall", "f1"], "metric", "value")


def pivot_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "level", "layer").pivot("metric", ["precision", "recall", "f1", "tp", "fp", "fn"]).agg(F.first("value"))
