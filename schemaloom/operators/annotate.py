"""A light rule tagger: tokens with part of speech, lemma, head and role, and noun chunks.

It stands in for a parser where none is installed. Closed classes are word lists, verbs a list of common ones with their
inflections, adjectives a few endings; everything else is a noun. Roles come from order: the noun before a verb is its
subject, the one after it its object, one after a preposition the preposition's. Sentences are lower-cased first; ``idx``
is the place of a token in its sentence. Annotations made elsewhere may be used instead: the columns are the contract.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKENS = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,idx:int>>"
CHUNKS = "array<struct<start:int,end:int>>"

# English closed classes, common verbs with irregular forms, and endings.
DETERMINERS = frozenset("a an the this that these those each every all both any some no its his her their our my your another".split())
PREPOSITIONS = frozenset("of in on at by for from to with without into onto over under between through during before after against about within across per via as near".split())
PRONOUNS = frozenset("i you he she it we they me him them us who whom which what himself itself themselves there".split())
CONJUNCTIONS = frozenset("and or but nor if because while although when than so".split())
AUXILIARIES = {"is": "be", "are": "be", "was": "be", "were": "be", "be": "be", "been": "be", "being": "be", "am": "be", "has": "have", "have": "have", "had": "have", "does": "do", "do": "do", "did": "do"} | {w: w for w in "will would can could shall should may might must".split()}
ADVERBS = frozenset("not also very only now then here soon again already never often too still just always".split())
VERBS = frozenset("""accept add approve assign buy call cancel charge check close complete contact contain cover create deliver describe employ
end extend file fix follow give grant handle hire include inspect install issue keep lead lease list make manage need notify occupy offer open
operate own pay perform prepare process produce provide receive reject rent repair replace report represent request require resolve review
schedule sell send serve sign start store submit supply support take update use visit want work write""".split())
PAST = {"bought": "buy", "gave": "give", "given": "give", "kept": "keep", "led": "lead", "made": "make", "paid": "pay", "sold": "sell", "sent": "send", "took": "take", "taken": "take", "wrote": "write", "written": "write"}
ADJECTIVES = frozenset("new old large small high low good bad first last next same other many few several main open annual monthly current total full great long short".split())
ADJECTIVE_ENDINGS = ("able", "ible", "ous", "ful", "less", "ive", "ical", "ial")

_TOKEN = re.compile(r"['\u2019]s\b|\w+(?:\.\w+)*|[^\w\s]")


def verb_lemma(word: str) -> str | None:
    """The verb of which the word is a form, if it is one of ``VERBS``."""
    if word in PAST:
        return PAST[word]
    for ending, puts in (("", ("",)), ("s", ("",)), ("es", ("", "e")), ("ies", ("y",)), ("ed", ("", "e")), ("ied", ("y",)), ("ing", ("", "e"))):
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)]
            for put in puts:
                if stem + put in VERBS:
                    return stem + put
            if ending in ("ed", "ing") and len(stem) > 2 and stem[-1] == stem[-2] and stem[:-1] in VERBS:
                return stem[:-1]
    return None


def _tag(words: list[str]) -> tuple[list[str], list[str]]:
    """Parts of speech and lemmas."""
    pos, lemma = [], []
    for k, w in enumerate(words):
        before = pos[-1] if pos else None
        p, base = "NOUN", w
        if re.fullmatch(r"['\u2019]s", w):
            p = "PART"
        elif not re.match(r"\w", w):
            p = "PUNCT"
        elif re.fullmatch(r"[\d.]+", w):
            p = "NUM"
        elif w in DETERMINERS:
            p = "DET"
        elif w in PREPOSITIONS:
            p = "ADP"
        elif w in PRONOUNS:
            p = "PRON"
        elif w in CONJUNCTIONS:
            p = "CCONJ"
        elif w in AUXILIARIES:
            p, base = "AUX", AUXILIARIES[w]
        elif w in ADJECTIVES:
            p = "ADJ"
        elif w in ADVERBS or (w.endswith("ly") and len(w) > 4):
            p = "ADV"
        elif (found := verb_lemma(w)) and before in ("NOUN", "PRON", "AUX", "ADV", "CCONJ") and not (before == "NOUN" and k + 1 < len(words) and words[k + 1] in AUXILIARIES) and (before != "NOUN" or w != found or (k + 1 < len(words) and re.match(r"\w", words[k + 1]))):
            p, base = "VERB", found
        elif len(w) > 5 and w.endswith(ADJECTIVE_ENDINGS):
            p = "ADJ"
        pos.append(p)
        lemma.append(base)
    return pos, lemma


def annotate_one(sentence: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    """(tokens, noun chunks) of a sentence."""
    low = sentence.lower()
    found = list(_TOKEN.finditer(low))
    words = [m[0] for m in found]
    pos, lemma = _tag(words)
    n = len(words)
    chunks, k = [], 0
    while k < n:
        e = k + (pos[k] == "DET")
        first = e
        while e < n and pos[e] in ("ADJ", "NOUN", "NUM"):
            e += 1
        while e > first and pos[e - 1] != "NOUN":
            e -= 1
        if e > first:
            chunks.append((k, e))
            k = e
        else:
            k += 1
    head, dep = list(range(n)), ["dep"] * n
    heads = {e - 1: (a, e) for a, e in chunks}
    for last, (a, _) in heads.items():
        for j in range(a, last):
            head[j], dep[j] = last, "det" if pos[j] == "DET" else "amod" if pos[j] == "ADJ" else "compound"
    verb = pending = prep = None
    served = False  # the verb has its object
    for j in range(n):
        if pos[j] == "VERB" or (pos[j] == "AUX" and not any(pos[m] == "VERB" for m in range(j + 1, min(n, j + 4)))):
            verb, served = j, False
            dep[j] = "ROOT"
            if pending is not None:
                head[pending], dep[pending] = j, "nsubj"
            pending = prep = None
        elif pos[j] == "ADP":
            prep = j
            head[j], dep[j] = (verb if verb is not None else max(0, j - 1)), "prep"
            if verb is None or (j and j - 1 in heads and words[j] == "of"):
                head[j] = j - 1 if j else j
        elif j in heads or pos[j] == "PRON":
            if prep is not None:
                head[j], dep[j], prep = prep, "pobj", None
            elif verb is not None:
                if not served:
                    head[j], dep[j], served = verb, "attr" if lemma[verb] == "be" else "dobj", True
                else:
                    pending = j
            else:
                pending = j
    tokens = [(k, words[k], lemma[k], pos[k], dep[k], head[k], found[k].start()) for k in range(n)]
    return tokens, chunks


def annotate(sents: DataFrame) -> DataFrame:
    """sents(sent_id, sentence) -> (sent_id, tokens, noun_chunks), one pass; null sentences have no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("i", "text", "lemma", "pos", "dep", "head", "idx")
        for b in batches:
            made = [annotate_one(s or "") for s in b["sentence"]]
            tokens = [[dict(zip(names, t)) for t in m[0]] for m in made]
            yield pd.DataFrame({"sent_id": b["sent_id"], "tokens": tokens, "noun_chunks": [[{"start": a, "end": e} for a, e in m[1]] for m in made]})

    kind = sents.schema["sent_id"].dataType.simpleString()
    return sents.select("sent_id", "sentence").mapInPandas(run, f"sent_id {kind}, tokens {TOKENS}, noun_chunks {CHUNKS}")
