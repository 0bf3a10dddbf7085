"""Questions as people type them into a search box, and how well a text answers one by its shortest covers.

Words are all wanted; "quoted words" stand together; ``or`` parts alternatives and binds least; ``-`` before a word or quotes bars it.
Anything can be typed: an open quote ends with the question, signs without words mean nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from memlake.search.analysis import words

_PART = re.compile(r'(-?)\s*"([^"]*)(?:"|$)|(-?)([^\s"]+)')
#: Fixed value: the weight of an occurrence in plain text.
WEIGHT = 0.1

Phrase = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Alternative:
    """Phrases that must be there and phrases that must not; a word is a phrase of one term. A phrase is terms with their distance from the first."""

    wanted: tuple[Phrase, ...]
    barred: tuple[Phrase, ...]


def parse(question: str, language: str = "english") -> tuple[Alternative, ...]:
    out, wanted, barred = [], [], []
    for sign, quoted, minus, bare in _PART.findall(question or ""):
        if bare.lower() == "or" and not minus:
            out.append((wanted, barred))
            wanted, barred = [], []
            continue
        found = [(t, at) for at, t in enumerate(words(bare or quoted, language)) if t]
        if found:
            phrase = tuple((t, at - found[0][1]) for t, at in found)
            (barred if sign or minus else wanted).append(phrase)
    return tuple(Alternative(tuple(dict.fromkeys(w)), tuple(dict.fromkeys(b))) for w, b in [*out, (wanted, barred)] if w)


def terms_of(question: tuple[Alternative, ...]) -> set[str]:
    return {t for a in question for p in (*a.wanted, *a.barred) for t, _ in p}


def _begins(phrase: Phrase, at: dict[str, list[int]]) -> list[int]:
    """Where a phrase begins, in order."""
    if len(phrase) == 1:
        return at.get(phrase[0][0], [])
    later = [(set(at.get(t, ())), d) for t, d in phrase[1:]]
    return [p for p in at.get(phrase[0][0], ()) if all(p + d in here for here, d in later)]


def covers(alternatives: list[Alternative], at: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
    """The shortest stretches that hold all that some alternative wants: first and last position, and how many of the question's terms lie
    between them. None holds another."""
    phrases = [[(_begins(p, at), p[-1][1]) for p in a.wanted] for a in alternatives]
    ends = sorted({b + length for alternative in phrases for begins, length in alternative for b in begins})
    seen = sorted({p for here in at.values() for p in here})
    last = 0
    for end in ends:
        # The latest beginning from which the stretch up to here holds an alternative.
        latest = lambda begins, length, end=end: begins[i - 1] if (i := bisect_right(begins, end - length)) else 0
        begin = max((min(latest(*phrase) for phrase in alternative) for alternative in phrases), default=0)
        if begin > last:
            yield begin, end, bisect_right(seen, end) - bisect_left(seen, begin)
            last = begin


def score(question: tuple[Alternative, ...], at: dict[str, list[int]]) -> float | None:
    """at: positions of terms in a text; those that the question does not name are of no account. None if the text is no answer, else the sum over its covers: a cover without other
    words between counts whole, one with n other words a (1 + n)th."""
    met = [a for a in question if all(_begins(p, at) for p in a.wanted) and not any(_begins(p, at) for p in a.barred)]
    if not met:
        return None
    own = {t: at[t] for t in terms_of(question) if t in at}
    return sum(WEIGHT / (1 + (q - p) - (n - 1)) for p, q, n in covers(met, own))
