"""Finds many texts in one: a single scan over an automaton of all of them. Helpers for batch functions; no Spark here."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import ahocorasick


def first_places(text: str, needles: Iterable[str]) -> dict[str, int]:
    """Where each needle begins first; needles that the text doesn't hold, and empty ones, are left out. The scan ends when all
    are found."""
    automaton = ahocorasick.Automaton()
    for needle in needles:
        if needle:
            automaton.add_word(needle, needle)
    missing, found = len(automaton), {}
    if not missing:
        return found
    automaton.make_automaton()
    for end, needle in automaton.iter(text):
        if needle not in found:
            found[needle] = end - len(needle) + 1
            if len(found) == missing:
                break
    return found


def first_lines(text: str, needles: Iterable[str]) -> dict[str, int]:
    """The number of the line on which each needle begins first."""
    places = first_places(text, needles)
    ends = list(accumulate(map(len, text.splitlines(keepends=True))))
    return {needle: bisect_right(ends, at) + 1 for needle, at in places.items()}
