"""Statistical induction: sentences, candidate terms, nesting, C-value, surface forms, attributes, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from schemaloom.functions.text import contains_tokens, length_factor, name_key, surface
from schemaloom.operators.runs import after_columns, counted_runs, ngram_columns
from schemaloom.sources.tables import written

MAX_TOKENS, MIN_FREQ, TOP_CLASSES, MIN_COOC, MAX_ATTRS = 4, 3, 20, 3, 10


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, sentence: blocks at blank lines, white space collapsed, cut after . ! or ? Numbered where they
    are, without a shuffle."""
    blocks = F.transform(F.split("text", r"\n\s*\n"), lambda b: F.split(F.trim(F.regexp_replace(b, r"\s+", " ")), r"(?<=[.!?]) "))
    parts = F.filter(F.flatten(blocks), lambda x: F.length(F.trim(x)) > 0)
    return docs.select("doc_id", F.posexplode(parts).alias("sent_no", "sentence"))


def _tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sent_no", F.expr("filter(split(lower(sentence), '[^a-z0-9]+'), x -> x <> '')").alias("t")).where(F.size("t") > 0)


def ngrams(sents: DataFrame, longest: int = MAX_TOKENS) -> DataFrame:
    """doc_id, sent_no, start, n_tokens, term: every run of 1 to ``longest`` word tokens (candidate mode without a tagger)."""
    runs = F.expr(f"explode(flatten(transform(sequence(0, size(t) - 1), i -> transform(sequence(1, least({longest}, size(t) - i)), n -> named_struct('start', i, 'n_tokens', n, 'term', array_join(slice(t, i + 1, n), ' '))))))")
    return _tokens(sents).select("doc_id", "sent_no", runs.alias("s")).select("doc_id", "sent_no", "s.*")


def ngram_frequencies(docs: DataFrame, longest: int = MAX_TOKENS, least: int = MIN_FREQ) -> DataFrame:
    """(term, n_tokens, freq) of ``frequencies(ngrams(sentences(docs)))``, counted by ``counted_runs``."""
    found = counted_runs(docs.select("text"), *ngram_columns(longest), longest, least)
    return found.select(F.when(F.col("n_tokens") == 1, F.col("head")).otherwise(F.concat_ws(" ", "head", "tail")).alias("term"), "n_tokens", "freq")


def spans(tokens: DataFrame, longest: int = MAX_TOKENS) -> DataFrame:
    """Of tagged sentences: every (ADJ|NOUN)* NOUN run of 1 to ``longest`` tokens, all lengths, as
    (sent_id, start, n_tokens, term); terms are the tokens' texts in lower case."""
    made = F.expr(f"""flatten(transform(sequence(1, {longest}), n -> transform(filter(sequence(0, greatest(size(tokens) - n, 0)),
        i -> i + n <= size(tokens) and tokens[i + n - 1].pos = 'NOUN' and forall(slice(tokens, i + 1, n), x -> x.pos in ('NOUN', 'ADJ'))),
        i -> named_struct('start', i, 'n_tokens', n, 'term', lower(array_join(transform(slice(tokens, i + 1, n), x -> x.text), ' '))))))""")
    return tokens.select("sent_id", F.explode(made).alias("s")).select("sent_id", "s.*")


def span_surfaces(tokens: DataFrame, originals: DataFrame, longest: int = MAX_TOKENS) -> DataFrame:
    """(term, form): the spans of tagged sentences as originals(sent_id, sentence) have them."""
    whole = tokens.join(originals.select("sent_id", "sentence"), "sent_id").withColumn("low", F.lower("sentence"))
    places = spans(tokens, longest).join(whole, "sent_id")
    first, last = F.expr("tokens[start]"), F.expr("tokens[start + n_tokens - 1]")
    return places.select("term", surface(F.col("sentence"), F.col("low"), first["idx"], last["idx"] + F.length(last["text"])).alias("form"))


def frequencies(candidates: DataFrame, least: int = MIN_FREQ) -> DataFrame:
    return candidates.groupBy("term", "n_tokens").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def _inside(terms: DataFrame, *also: str) -> DataFrame:
    """(term, container, *also): each shorter run of words once for each term that holds it, with columns of that term."""
    sub = F.expr("array_distinct(flatten(transform(sequence(1, size(t) - 1), n -> transform(sequence(0, size(t) - n), i -> array_join(slice(t, i + 1, n), ' ')))))")
    longer = terms.where("n_tokens > 1").select(F.col("term").alias("container"), *also, F.split("term", " ").alias("t"))
    return longer.select(F.explode(sub).alias("term"), "container", *also)


def nesting(terms: DataFrame, closed: bool = False) -> DataFrame:
    """(term, container): terms, each in one row, inside longer ones. An equi-join on the sub-spans of each term, not a
    comparison of all pairs. ``closed``: whatever stands inside a term is a term, as it is of ``ngram_frequencies``, where
    it comes at least as often; then nothing is joined."""
    pieces = _inside(terms)
    return pieces if closed else pieces.join(terms.select("term"), "term")


def c_value(terms: DataFrame) -> DataFrame:
    """term, n_tokens, freq, score: log2(tokens + 1) x (frequency - mean frequency of the terms that contain it)."""
    mean = _inside(terms, "freq").groupBy("term").agg(F.avg("freq").alias("mean"))
    return terms.join(mean, "term", "left").select("term", "n_tokens", "freq", (length_factor(F.col("n_tokens")) * (F.col("freq") - F.coalesce("mean", F.lit(0.0)))).alias("score"))


def top_classes(scored: DataFrame, n: int = TOP_CLASSES) -> DataFrame:
    return scored.orderBy(F.desc("score"), "term").limit(n)


def surface_forms(names: DataFrame, column: str) -> DataFrame:
    """key, form: the most frequent spelling of each key, ties to the smallest."""
    counted = names.select(F.col(column).alias("form"), name_key(F.col(column)).alias("key")).groupBy("key", "form").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"))


def attributes(candidates: DataFrame, classes: DataFrame, least: int = MIN_COOC, most: int = MAX_ATTRS, guards: DataFrame | None = None) -> DataFrame:
    """class, attr, n: terms right after a class, at least ``least`` times, the first ``most`` of each class.

    candidates(doc_id, sent_no, start, n_tokens, term), classes(term). Joined on the position where one ends and
    the other starts; an attribute is no class and doesn't hold its class.
    """
    named = classes.select("term")
    left = candidates.join(named, "term").select("doc_id", "sent_no", (F.col("start") + F.col("n_tokens")).alias("start"), F.col("term").alias("class"))
    right = candidates.join(named, "term", "left_anti").select("doc_id", "sent_no", "start", F.col("term").alias("attr"))
    right = right.join(guards.select(F.col("term").alias("attr")), "attr", "left_semi") if guards is not None else right
    hits = left.join(right, ["doc_id", "sent_no", "start"]).where(~contains_tokens(F.col("attr"), F.col("class")))
    return capped(hits.groupBy("class", "attr").agg(F.count("*").alias("n")), least, most)


def ngram_attributes(docs: DataFrame, classes: DataFrame, longest: int = MAX_TOKENS, least: int = MIN_COOC, most: int = MAX_ATTRS, guards: DataFrame | None = None) -> DataFrame:
    """``attributes(ngrams(sentences(docs)), classes)``: only runs that begin with a class are made, and counted by
    ``counted_runs``; the rules on attributes, which look at names alone, come after. Classes are few (``TOP_CLASSES``)."""
    names = [r.term for r in classes.select("term").distinct().collect()]
    found = counted_runs(docs.select("text"), *after_columns(names, longest), longest + 1, least).where("n_tokens > 1")
    found = found.select(F.col("head").alias("class"), F.col("tail").alias("attr"), F.col("freq").alias("n"))
    found = found.where(~F.col("attr").isin(names) & ~contains_tokens(F.col("attr"), F.col("class")))
    found = found.join(guards.select(F.col("term").alias("attr")), "attr", "left_semi") if guards is not None else found
    return capped(found.select("class", "attr", "n"), least, most)


def grammar_attributes(tokens: DataFrame, classes: DataFrame, terms: DataFrame) -> DataFrame:
    """(class, attr, n) from tagged sentences: attr is a term, no class, and doesn't hold its class. It counts where it
    follows the class after 's or a colon; follows it at once inside one noun chunk; or stands before "of", with
    determiners between "of" and the class left out. Each pattern is an equi-join on a position of the sentence."""
    named = classes.select("term").distinct()
    all_ = spans(tokens)
    of = all_.join(named, "term").select("sent_id", F.col("term").alias("class"), "start", (F.col("start") + F.col("n_tokens")).alias("next"))
    of = of.join(tokens.select("sent_id", "tokens", "noun_chunks"), "sent_id")
    before = F.expr("array_max(filter(sequence(-1, start - 1), j -> j = -1 or tokens[j].pos <> 'DET'))")
    of = of.withColumn("sign", F.when(F.col("next") < F.size("tokens"), F.expr("tokens[next].text"))).withColumn("prep", before)
    of = of.withColumn("prep", F.when((F.col("prep") >= 1) & (F.expr("tokens[greatest(prep, 0)].text") == "of"), F.col("prep")))
    of = of.withColumn("chunk_end", F.expr("array_max(transform(filter(noun_chunks, c -> c.start <= start), c -> c.end))")).drop("tokens", "noun_chunks")
    attr = all_.join(named, "term", "left_anti").join(terms.select("term"), "term", "left_semi")
    attr = attr.select("sent_id", F.col("term").alias("attr"), F.col("start").alias("at"), (F.col("start") + F.col("n_tokens")).alias("end"))
    own = of.where(F.col("sign").isin("'s", "\u2019s", ":")).select("sent_id", "class", (F.col("next") + 1).alias("at")).join(attr, ["sent_id", "at"])
    compound = of.select("sent_id", "class", F.col("next").alias("at"), "chunk_end").join(attr, ["sent_id", "at"]).where(F.col("end") <= F.col("chunk_end"))
    part = of.where("prep is not null").select("sent_id", "class", F.col("prep").alias("end")).join(attr, ["sent_id", "end"])
    pick = lambda df: df.select("class", "attr")
    hits = pick(own).union(pick(compound)).union(pick(part)).where(~contains_tokens(F.col("attr"), F.col("class")))
    return hits.groupBy("class", "attr").agg(F.count("*").alias("n"))


def capped(counted: DataFrame, least: int = MIN_COOC, most: int = MAX_ATTRS) -> DataFrame:
    """(class, attr, n, rank): the first ``most`` of each class that come at least ``least`` times, by count, then name."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "attr"))
    return counted.where(F.col("n") >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def triples(tokens: DataFrame, classes: DataFrame, least: int = 1) -> DataFrame:
    """subj, verb, obj, n from tagged and parsed sentences: subjects and objects of a verb (not "be"), objects also
    below a preposition; each end is the longest class that ends at its token; equal ends are dropped."""
    t = tokens.select("sent_id", F.col("tokens").alias("all"), F.explode("tokens").alias("t"))
    ends = t.select("sent_id", F.col("t.i").alias("i"), F.col("t.dep").alias("dep"), F.col("t.head").alias("head"), F.explode(F.expr(f"transform(sequence(1, least({MAX_TOKENS}, t.i + 1)), n -> named_struct('n', n, 'term', lower(array_join(transform(slice(all, t.i - n + 2, n), x -> x.text), ' '))))")).alias("s"))
    ends = ends.join(classes.select(F.col("term").alias("name")), F.col("s.term") == F.col("name"))
    ends = ends.groupBy("sent_id", "i", "dep", "head").agg(F.max_by("name", "s.n").alias("name"))
    verbs = t.where("t.pos in ('VERB', 'AUX') and lower(t.lemma) <> 'be'").select("sent_id", F.col("t.i").alias("verb_i"), F.col("t.lemma").alias("verb"))
    preps = t.where("t.dep = 'prep'").select("sent_id", F.col("t.i").alias("prep_i"), F.col("t.head").alias("verb_i"))
    subjects = ends.where("dep in ('nsubj', 'nsubjpass')").select("sent_id", F.col("head").alias("verb_i"), F.col("name").alias("subj"))
    objects = ends.where("dep in ('dobj', 'pobj', 'attr', 'obj')").select("sent_id", "head", F.col("name").alias("obj"))
    direct = objects.select("sent_id", F.col("head").alias("verb_i"), "obj")
    below = objects.join(preps, (objects.sent_id == preps.sent_id) & (F.col("head") == F.col("prep_i"))).select(objects.sent_id, "verb_i", "obj")
    found = verbs.join(subjects, ["sent_id", "verb_i"]).join(direct.union(below), ["sent_id", "verb_i"]).where("subj <> obj")
    return found.groupBy("subj", "verb", "obj").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def ranked_relations(counted: DataFrame) -> DataFrame:
    """Triples by count, then by name."""
    return counted.orderBy(F.desc("n"), "subj", "verb", "obj")


def induce_schema(tokens: DataFrame, originals: DataFrame, n_classes: int = TOP_CLASSES, least_relation: int = 3) -> tuple[DataFrame, DataFrame]:
    """(classes(pos, name, parent, attributes), relations(pos, source, label, target)) of a tagged corpus.

    Terms are ranked by C-value and the first become classes; their attributes and relations come from the sentences.
    Names are the spellings seen most. ``pos`` keeps the order of rank. Tokens are read once for each use, so they should
    be a written table."""
    terms = written(frequencies(spans(tokens)))
    forms = written(surface_of_terms(span_surfaces(tokens, originals)))
    top = written(top_classes(c_value(terms), n_classes))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "term"))  # of n_classes rows
    named = lambda df, key, out: df.join(forms.select(F.col("term").alias(key), F.col("form").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))
    attrs = named(capped(grammar_attributes(tokens, top, terms)), "attr", "attr_name")
    attrs = attrs.groupBy(F.col("class").alias("term")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "attr_name"))), lambda x: x["attr_name"]).alias("attributes"))
    classes = named(top.withColumn("pos", place - 1), "term", "name").join(attrs, "term", "left")
    classes = classes.select("pos", "name", F.lit(None).cast("string").alias("parent"), F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))
    found = triples(tokens, top, least_relation)
    found = named(named(found, "subj", "source"), "obj", "target")
    order = Window.orderBy(F.desc("n"), "subj", "verb", "obj")  # of pairs of n_classes classes and their verbs
    return classes, found.select((F.row_number().over(order) - 1).alias("pos"), "source", F.col("verb").alias("label"), "target")


def surface_of_terms(found: DataFrame) -> DataFrame:
    """(term, form): the most frequent spelling of each term, ties to the smallest."""
    counted = found.groupBy("term", "form").agg(F.count("*").alias("n"))
    return counted.groupBy("term").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"))
