"""Which terms of a glossary a text holds, by one automaton over all terms, built once in a worker."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

STRINGS = ArrayType(StringType())
#: The last automaton a worker has built: a task uses one, and another part of a glossary takes its place.
_LAST: list[tuple[object, Finder]] = []


class Finder:
    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            self.automaton.add_word(term, (place, term))
        if terms:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        """The terms that the text holds, each once, in the glossary's order."""
        if not text or not len(self.automaton):
            return []
        return [term for _, term in sorted({found for _, found in self.automaton.iter(text)})]


def finder(shared) -> Finder:
    if not _LAST or _LAST[0][0] is not shared:
        _LAST[:] = [(shared, Finder(shared.value))]
    return _LAST[0][1]


def held(shared) -> Callable:
    """A function of a text column: the terms it holds. shared: a broadcast list of distinct terms, none empty."""

    @F.arrow_udf(STRINGS)
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(map(finder(shared), texts.to_pylist()), pa.list_(pa.string()))

    return of


def lost(shared) -> Callable:
    """A function of two text columns: the terms that the first holds and the second doesn't."""

    @F.arrow_udf(STRINGS)
    def of(sources: pa.Array, results: pa.Array) -> pa.Array:
        find = finder(shared)

        def one(source: str | None, result: str | None) -> list[str]:
            terms = find(source)
            return [t for t in terms if t not in kept] if terms and (kept := set(find(result))) else terms

        return pa.array(map(one, sources.to_pylist(), results.to_pylist()), pa.list_(pa.string()))

    return of


def standing(term: str) -> re.Pattern:
    """The term where no letter, digit or underscore touches it."""
    return re.compile(rf"(?<!\w){re.escape(term)}(?!\w)")
