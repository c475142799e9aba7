"""English stemmers: Porter (1980) and its revision (Porter2). Applied to distinct terms, through Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix lists of the published algorithms, longest match first where order matters.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
STEP2_REVISED = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogi:og li:"
STEP3_REVISED = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
STEP4_REVISED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
EXCEPTIONS = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
KEPT_AFTER_1A = "inning outing canning herring earring proceed exceed succeed"
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = "bb dd ff gg mm nn pp rr tt"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple(x.split(":")) for x in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


def _longest(word: str, rules: list) -> tuple | None:
    return next((r for r in rules if word.endswith(r[0])), None)


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_P2, _P3 = _rules(STEP2), _rules(STEP3)
_P4 = sorted(((s,) for s in STEP4.split()), key=lambda p: -len(p[0]))


def porter(word: str) -> str:
    """The stem of a lower-case word by the algorithm of 1980; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_P2, _P3):
        hit = _longest(w, rules)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = _longest(w, _P4)
    if hit:
        stem = w[: -len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_S2, _S3 = _rules(STEP2_REVISED), _rules(STEP3_REVISED)
_S4 = sorted(((s,) for s in STEP4_REVISED.split()), key=lambda p: -len(p[0]))
_SPECIAL = dict(x.split(":") for x in EXCEPTIONS.split())
_KEPT = frozenset(KEPT_AFTER_1A.split())
_VOWEL, _DOUBLE = "aeiouy", frozenset(DOUBLES.split())


def _region(word: str, start: int) -> int:
    m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"(?:^[{_VOWEL}][^{_VOWEL}]|[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY])$", w))


def porter2(word: str) -> str:
    """The stem of a lower-case word by the revised algorithm."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub(f"^y|(?<=[{_VOWEL}])y", "Y", w)
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    hit = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), None)
    if hit in ("eed", "eedly"):
        if len(w) - len(hit) >= r1:
            w = w[: -len(hit)] + "ee"
    elif hit and re.search(f"[{_VOWEL}]", w[: -len(hit)]):
        w = w[: -len(hit)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in _DOUBLE:
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    hit = _longest(w, _S2)
    if hit:
        stem = w[: -len(hit[0])]
        fits = {"ogi": stem.endswith("l"), "li": stem[-1:] in tuple(LI_ENDINGS)}.get(hit[0], True)
        if len(stem) >= r1 and fits:
            w = stem + hit[1]
    hit = _longest(w, _S3)
    if hit:
        stem = w[: -len(hit[0])]
        if len(stem) >= (r2 if hit[0] == "ative" else r1):
            w = stem + hit[1]
    hit = _longest(w, _S4)
    if hit:
        stem = w[: -len(hit[0])]
        if len(stem) >= r2 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


STEMMERS: dict[str, Callable[[str], str] | None] = {"none": None, "porter": porter, "snowball": porter2}


def stem(c: Column, name: str) -> Column:
    """The stem of a column of lower-case words; for long columns ``stem_terms`` is cheaper."""
    rule = STEMMERS[name]
    if rule is None:
        return c

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(rule, na_action="ignore")

    return run(c)


def stem_terms(df: DataFrame, term: str, name: str) -> DataFrame:
    """``df`` with the column ``term`` stemmed; each distinct term goes through Python once."""
    if STEMMERS[name] is None:
        return df
    known = df.select(term).distinct().withColumn("_stem", stem(F.col(term), name))
    return df.join(known, term, "left").drop(term).withColumnRenamed("_stem", term)
