"""Column functions on names and texts. All are built from Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Plurals that the rules below get wrong, with their singulars.
IRREGULAR = {
    "people": "person", "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose",
    "data": "datum", "criteria": "criterion", "phenomena": "phenomenon", "indices": "index", "matrices": "matrix", "vertices": "vertex", "appendices": "appendix",
    "analyses": "analysis", "crises": "crisis", "theses": "thesis", "hypotheses": "hypothesis", "diagnoses": "diagnosis", "parentheses": "parenthesis",
    "knives": "knife", "lives": "life", "wives": "wife", "leaves": "leaf", "halves": "half", "shelves": "shelf", "wolves": "wolf", "thieves": "thief", "loaves": "loaf", "calves": "calf",
    "buses": "bus", "gases": "gas", "viruses": "virus", "statuses": "status", "bonuses": "bonus", "campuses": "campus", "quizzes": "quiz",
    "heroes": "hero", "potatoes": "potato", "tomatoes": "tomato", "echoes": "echo", "vetoes": "veto", "cargoes": "cargo",
    "movies": "movie", "cookies": "cookie", "calories": "calorie", "rookies": "rookie", "ties": "tie", "pies": "pie", "dies": "die", "lies": "lie",
    "caches": "cache", "aches": "ache", "headaches": "headache", "axes": "axis", "series": "series", "species": "species", "news": "news", "lens": "lens", "always": "always",
}


def singular(token: Column) -> Column:
    """Singular of a lower-case token by ordered rules; tokens that no rule knows stay as they are."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return (
        F.when(F.element_at(irregular, token).isNotNull(), F.element_at(irregular, token))
        .when(F.length(token) <= 3, token)
        .when(token.rlike("(ss|us|is)$"), token)
        .when(token.rlike("ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(ss|x|zz|ch|sh)es$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def normalize(name: Column) -> Column:
    """Canonical form of a name: camel case and separators to spaces, lower case, other signs dropped, tokens singular."""
    x = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    x = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.array_join(F.transform(F.split(x, " "), singular), " ")


def name_key(x: Column) -> Column:
    """Grouping key of a producer: white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def usable(x: Column) -> Column:
    return x.isNotNull() & (F.length(F.trim(F.regexp_replace(x, r"\s+", " "))) > 0)


def contains_tokens(hay: Column, needle: Column) -> Column:
    """needle's tokens stand side by side in hay."""
    return F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def length_factor(tokens: Column) -> Column:
    return F.log2(tokens + F.lit(1))


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, "[^#/]*$", 0)


def strip_reasoning(text: Column) -> Column:
    """Without closed reasoning blocks; then what follows the last stray end, unless a block is still open."""
    closed = F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think>", "")
    stray = F.regexp_replace(closed, r"(?is)^.*</think>", "")
    return F.trim(F.when(F.contains(F.lower(closed), F.lit("<think")), closed).otherwise(stray))


def strip_fences(text: Column) -> Column:
    """Content of the first fenced block, or the text."""
    inner = F.regexp_extract(text, r"(?s)```[a-zA-Z0-9_-]*\n(.*?)```", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def add_months_clamped(date: Column, months) -> Column:
    """The date so many months on, its day at most 28."""
    first = F.add_months(F.trunc(date, "month"), months)
    return F.date_add(first, F.least(F.dayofmonth(date), F.lit(28)) - 1)


def surface(original: Column, lowered: Column, start: Column, end: Column) -> Column:
    """The slice start..end (characters, end excluded) of a text as it was written; of its lower-cased form where lowering
    changed the length, so that offsets don't carry over."""
    kept = F.when(F.length(original) == F.length(lowered), original).otherwise(lowered)
    return F.substr(kept, start + 1, end - start)


def random_date(first_year: int, last_year: int, chance: Column) -> Column:
    """A day of the years first..last; ``chance`` in [0, 1) picks it evenly."""
    start = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    days = F.date_diff(F.make_date(F.lit(last_year + 1), F.lit(1), F.lit(1)), start)
    return F.date_add(start, F.floor(chance * days).cast("int"))


def email(local: Column, domain: Column) -> Column:
    """local part with dots for spaces @ domain without spaces .com, lower case."""
    return F.lower(F.concat(F.replace(local, F.lit(" "), F.lit(".")), F.lit("@"), F.replace(domain, F.lit(" "), F.lit("")), F.lit(".com")))


def padded_id(prefix: str, n: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))
