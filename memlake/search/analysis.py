"""Texts as terms with positions, for the positional index and for questions alike."""

from __future__ import annotations

import re

from memlake.search.english import stem

#: English words too common to be searched for. They keep their positions, so phrases stay exact.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
_WORD = re.compile(r"[^\W_]+(?:'s\b)?")
_PLAIN = re.compile(r"[^\W_]+")


def words(text: str | None, language: str) -> list[str | None]:
    """The terms of a text by position. ``english``: stems, None for stop words; ``simple``: words lower-cased."""
    lower = (text or "").lower()
    if language == "simple":
        return _PLAIN.findall(lower)
    return [None if w in STOP_WORDS else stem(w) for w in _WORD.findall(lower)]


def positions(text: str | None, language: str) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for at, term in enumerate(words(text, language), 1):
        if term:
            found.setdefault(term, []).append(at)
    return found
