"""Glossaries of any size against texts of any number: an automaton goes to the texts, the texts are never joined with the terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .tables import settled

#: Bytes of terms, and a share for each, that go to the workers at once; a larger glossary takes several rounds.
PART = 64 << 20


def parts(spark: SparkSession, terms: DataFrame | list[str], term: str = "term", part: int = PART) -> Iterator[Broadcast]:
    """Broadcast lists that together are the distinct terms, none larger than about `part` bytes; null and empty terms are none. A list keeps its order."""
    if isinstance(terms, list):
        own, size = [], 0
        for t in dict.fromkeys(t for t in terms if t):
            if size and size + len(t.encode()) + 64 > part:
                yield spark.sparkContext.broadcast(own)
                own, size = [], 0
            own.append(t)
            size += len(t.encode()) + 64
        yield spark.sparkContext.broadcast(own)
        return
    known = terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    rounds = -(-size // part) or 1
    for k in range(rounds):
        own = known if rounds == 1 else known.where(F.pmod(F.xxhash64("term"), F.lit(rounds)) == k)
        yield spark.sparkContext.broadcast(sorted(r.term for r in own.toLocalIterator()))


def _exploded(rows: DataFrame, terms: DataFrame | list[str], found: Callable[[Broadcast], Column], term: str, part: int) -> DataFrame:
    out = None
    for shared in parts(rows.sparkSession, terms, term, part):
        now = rows.withColumn(term, F.explode(found(shared)))
        out = now if out is None else out.unionByName(now)
    return out


def contained(rows: DataFrame, terms: DataFrame | list[str], text: str = "text", term: str = "term", part: int = PART) -> DataFrame:
    """rows with each term their text holds, a row for each."""
    return _exploded(rows, terms, lambda shared: T.held(shared)(F.col(text)), term, part)


def violations(rows: DataFrame, terms: DataFrame | list[str], source: str = "source", result: str = "result", term: str = "term", part: int = PART) -> DataFrame:
    """rows with each term their source holds and their result lacks, a row for each. A null result lacks all."""
    return _exploded(rows, terms, lambda shared: T.lost(shared)(F.col(source), F.col(result)), term, part)


def with_terms(rows: DataFrame, terms: DataFrame | list[str], text: str, name: str, term: str = "term", part: int = PART) -> DataFrame:
    """rows with an array of the terms their text holds; between the rounds of a large glossary rows are written."""
    out, first = rows, True
    for shared in parts(rows.sparkSession, terms, term, part):
        if first:
            out, first = rows.withColumn(name, T.held(shared)(F.col(text))), False
        else:
            out = settled(out, "terms").withColumn(name, F.concat(name, T.held(shared)(F.col(text))))
    return out
