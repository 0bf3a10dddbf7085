"""English stems by rules: suffixes dropped or replaced, step by step, where enough of the word is left (the published Porter2 rules)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffixes and what replaces them, the words that rules would spoil, and the endings that may stand before -li.
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
STEP2 = dict(x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split())
STEP3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
SPECIAL = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LI_ENDINGS = "cdeghkmnrt"

_VOWEL, _REST = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_REST}")
_SHORT = re.compile(f"(?:{_REST}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_REST})$")


def _region(word: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _first_region(word: str) -> int:
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            return len(prefix)
    return _region(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return w
    rest = w[: -len(suffix)]
    if suffix.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else w
    if not re.search(_VOWEL, rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in DOUBLES:
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT.search(rest) else rest


def _replaced(w: str, r1: int, r2: int) -> str:
    suffix = _longest(w, STEP2)
    if suffix is not None and len(w) - len(suffix) >= r1:
        rest = w[: -len(suffix)]
        if not (suffix == "li" and rest[-1:] not in LI_ENDINGS or suffix == "ogi" and not rest.endswith("l")):
            w = rest + STEP2[suffix]
    suffix = _longest(w, STEP3)
    if suffix is not None and len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
        w = w[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(w, STEP4)
    if suffix is not None and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    return w


def _final(w: str, r1: int, r2: int) -> str:
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) > r2 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """word: lower-cased."""
    w = word.removeprefix("'")
    if len(w) <= 2 or w in KEPT:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    # A y that begins a word or follows a vowel is no vowel.
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", w)
    r1 = _first_region(w)
    r2 = _region(w, r1)
    w = _plural(re.sub(r"('s'|'s|')$", "", w))
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not re.match(_VOWEL, w[-2]):
        w = w[:-1] + "i"
    return _final(_replaced(w, r1, r2), r1, r2).replace("Y", "y")
