"""Masking of protected pieces by numbered tokens, restoring them, and masking of personal data in nested events."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.slices import over_slices, sliced
from ..functions.terms import finder, standing
from ..functions.text import mask_pii
from .glossary import parts, with_terms
from .ordering import ranges, totals
from .tables import settled

#: What is protected, in the order of numbering. A group named x is what the token replaces; without one, the whole match.
MARKDOWN_RULES = [
    ("IMAGEPATH", r"!\[([^\]]*)\]\((?P<x>[^)]+)\)"),
    ("LINKURL", r"(?<!!)\[([^\]]+)\]\((?P<x>[^)]+)\)"),
    ("REF", r"(?<!!)\[([^\]]+)\]\[(?P<x>[^\]]*)\]"),
    ("AUTOLINK", r"<https?://[^>]+>"),
    ("URL", r"(?<!\()\bhttps?://[^\s)\]}>\"]+"),
    ("CODE", r"`[^`\n]+`"),
    ("MATH", r"\$[^$\n]+\$"),
    ("TEMPLATE", r"({[{%#].*?[}%]})"),
    ("TEMPLATE", r"<%.*?%>"),
    ("VARIABLE", r"\$\{[^}\n]+\}"),
    ("HTML_COMMENT", r"<!--.*?-->"),
    ("HTML_TAG", r"</?[^>\n]+?>"),
]
BOOK_RULES = [("URL", r"\bhttps?://[^\s<>\"']+"), ("EMAIL", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"), ("VARIABLE", r"\{\{[^{}]+\}\}|\{[A-Za-z_][\w.]*\}|\$\{[^}]+\}|<%[^%]+%>")]
TOKEN = StructType([StructField(c, StringType()) for c in ("id", "value", "kind")])
MASKED = StructType([StructField("masked", StringType()), StructField("tokens", ArrayType(TOKEN))])
FOUND = StructType([*MASKED.fields, StructField("terms", ArrayType(StringType()))])
#: Tokens times characters up to which tokens are put back one after the other.
SHORT = 1 << 18
#: A token's name, with what comes before its number.
NUMBERED = re.compile(r"(__.*?[^0-9])[0-9]+__", re.S)


class Masked:
    """A text under masking: what is left of it, and its tokens, numbered from start + 1."""

    def __init__(self, text: str | None, prefix: str, start: int = 0, tokens: list[tuple[str, str, str]] | None = None):
        self.text, self.prefix, self.start, self.tokens = text or "", prefix, start, list(tokens or [])

    def hide(self, kind: str, pattern: str | re.Pattern) -> None:
        def put(m: re.Match) -> str:
            value = m["x"] if "x" in m.re.groupindex else m[0]
            name = f"__{self.prefix}_{kind}_{self.start + len(self.tokens) + 1:04d}__"
            self.tokens.append((name, value, kind.lower()))
            at = (m.start("x") if "x" in m.re.groupindex else m.start()) - m.start()
            return m[0][:at] + name + m[0][at + len(value) :]

        self.text = re.sub(pattern, put, self.text)

    def hide_terms(self, terms: list[str]) -> None:
        """The longest first; of equal length in the order given."""
        for term in sorted((t for t in terms if t), key=len, reverse=True):
            self.hide("TERM", standing(term))


def _column(found: list[Masked]) -> pa.Array:
    """(masked, tokens) of each text."""
    flat = [t for m in found for t in m.tokens]
    fields = [pa.array([t[k] for t in flat], pa.string()) for k in range(3)]
    ends = np.concatenate([[0], np.cumsum([len(m.tokens) for m in found], dtype=np.int64)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["id", "value", "kind"]))
    return pa.StructArray.from_arrays([pa.array([m.text for m in found], pa.string()), tokens], ["masked", "tokens"])


def _token_lists(column: pa.Array) -> list[list[tuple[str, str, str]]]:
    flat = column.flatten()
    rows = list(zip(*(flat.field(c).to_pylist() for c in ("id", "value", "kind")), strict=True))
    ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def by_rules(rules: list[tuple[str, str]], prefix: str, shared=None):
    """A function of a text column: masked, tokens and terms, by the rules and the broadcast terms, numbered from 1. One worker does both."""
    patterns = [(kind, re.compile(pattern)) for kind, pattern in rules]
    to = to_arrow_type(FOUND)

    def own(texts: pa.Array) -> pa.Array:
        found, terms = [Masked(t, prefix) for t in texts.to_pylist()], []
        find = finder(shared) if shared else lambda _: []
        for m in found:
            for kind, pattern in patterns:
                m.hide(kind, pattern)
            terms.append(find(m.text))
            m.hide_terms(terms[-1])
        done = _column(found)
        return pa.StructArray.from_arrays([*done.flatten(), pa.array(terms, to.field("terms").type)], ["masked", "tokens", "terms"])

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        return over_slices(own, [texts], to)

    return of


def by_terms(prefix: str):
    """A function of masked, tokens and the terms a text holds: (masked, tokens) with the terms hidden too."""

    def own(texts: pa.Array, tokens: pa.Array, terms: pa.Array) -> pa.Array:
        found = [Masked(t, prefix, 0, known) for t, known in zip(texts.to_pylist(), _token_lists(tokens), strict=True)]
        for m, held in zip(found, terms.to_pylist(), strict=True):
            m.hide_terms(held)
        return _column(found)

    @F.arrow_udf(MASKED)
    def of(texts: pa.Array, tokens: pa.Array, terms: pa.Array) -> pa.Array:
        return over_slices(own, [texts, tokens, terms], to_arrow_type(MASKED))

    return of


def renumbered(rules: list[tuple[str, str]], prefix: str):
    """A function of text, masked, tokens, terms and a number: the tokens' numbers raised by it, wherever they stand."""
    mark = re.compile(rf"(__{re.escape(prefix)}_[A-Z_]+_)(\d{{4,}})(?=__)")

    def one(text: str, done: str, known: list, held: list[str], start: int) -> Masked:
        if start and known and f"__{prefix}_" in text:
            # the text has what looks like tokens of its own: they keep their numbers, so it is masked again from the start
            m = Masked(text, prefix, start)
            for kind, pattern in rules:
                m.hide(kind, pattern)
            m.hide_terms(held)
            return m
        if not start or not known:
            return Masked(done, prefix, 0, known)
        raised = lambda x: mark.sub(lambda k: f"{k[1]}{int(k[2]) + start:04d}", x) if f"__{prefix}_" in x else x
        # the tokens of a segment are numbered from 1 as they come
        return Masked(raised(done), prefix, 0, [(f"{i[: i.rindex('_', 0, -2)]}_{n:04d}__", raised(v), kind) for n, (i, v, kind) in enumerate(known, start + 1)])

    def own(texts: pa.Array, masked: pa.Array, tokens: pa.Array, terms: pa.Array, starts: pa.Array) -> pa.Array:
        return _column([one(*x) for x in zip(texts.to_pylist(), masked.to_pylist(), _token_lists(tokens), terms.to_pylist(), starts.to_pylist(), strict=True)])

    @F.arrow_udf(MASKED)
    def of(texts: pa.Array, masked: pa.Array, tokens: pa.Array, terms: pa.Array, starts: pa.Array) -> pa.Array:
        return over_slices(own, [texts, masked, tokens, terms, starts], to_arrow_type(MASKED))

    return of


def mask_tokens(segments: DataFrame, terms: DataFrame | list[str] | None = None, rules: list[tuple[str, str]] | None = None, doc: str = "doc_id", order: str = "ord", text: str = "text", prefix: str = "DOCSTR") -> DataFrame:
    """segments with masked and tokens, numbered along each document by `order`. Null texts count as empty.

    Segments are laid in ranges of equal counts and masked each by itself, once; sums of the counts of tokens before a segment then raise
    its numbers. So a document may have any number of segments, and no task holds one whole. terms: a list, or a table with a column term, which counts as sorted; which of
    them a segment holds is found by an automaton, so their number doesn't matter to a segment.
    """
    rules = MARKDOWN_RULES if rules is None else rules
    columns, whole = segments.columns, F.coalesce(F.col(text), F.lit(""))
    rows = ranges(segments, [doc], order)
    known = [] if terms is None or isinstance(terms, list) and not any(terms) else parts(rows.sparkSession, terms)
    first = list(islice(known, 2))
    rows = rows.withColumn("_m", by_rules(rules, prefix, first[0] if len(first) == 1 else None)(whole))
    if len(first) > 1:
        rows = with_terms(rows.withColumn("_masked", F.col("_m.masked")), terms, "_masked", "_terms")
        rows = rows.withColumn("_m", by_terms(prefix)("_masked", "_m.tokens", "_terms")).drop("_masked")
    else:
        rows = rows.withColumn("_terms", F.col("_m.terms"))
    rows = totals(settled(rows.withColumn("_m", F.struct("_m.masked", "_m.tokens")), "masked"), [doc], {"_before": F.size("_m.tokens")})
    rows = rows.withColumn("_m", renumbered(rules, prefix)(whole, "_m.masked", "_m.tokens", "_terms", "_before"))
    return rows.select(*columns, F.col("_m.masked").alias("masked"), F.col("_m.tokens").alias("tokens"))


def _put_back(masked: str, tokens: list[tuple[str, str]]) -> str:
    for name, value in reversed(tokens):
        masked = masked.replace(name, value)
    return masked


@lru_cache(64)
def _names(stems: frozenset[str]) -> tuple[re.Pattern, re.Pattern]:
    """What is a name with one of the stems, and what may be the end of one that runs into the beginning of another."""
    either = lambda of: "(?:" + "|".join(map(re.escape, sorted(of, key=len, reverse=True))) + ")"
    return re.compile(either(stems) + "[0-9]+__"), re.compile("[0-9]__" + either({s[n:] for s in stems for n in (1, 2)}))


def restore(masked: str | None, tokens: list[tuple[str, str]] | None) -> str | None:
    """What replacing one token after the other gives, the last first, in one pass over the text and the values.

    A value may hold tokens numbered before its own. Where names of tokens run into each other, where there are pieces of names, or where
    values bring new ones, it goes by one after the other; so it does for names that aren't numbered.
    """
    if masked is None or tokens is None:
        return None
    if len(tokens) * len(masked) <= SHORT:
        return _put_back(masked, tokens)
    place = {name: k for k, (name, _) in enumerate(tokens)}
    split = [NUMBERED.fullmatch(name) for name in place]
    if len(place) < len(tokens) or not all(split):
        return _put_back(masked, tokens)
    stems = frozenset(m[1] for m in split)
    names, joined = _names(stems)
    values: list[str] = []

    def whole(text: str, most: int) -> str:
        """text with those of the first `most` tokens put back that it holds."""
        return names.sub(lambda m: values[k] if (k := place.get(m[0], most)) < most else m[0], text)

    for k, (_, value) in enumerate(tokens):
        values.append(whole(value, k) if "__" in value else value)
    out = whole(masked, len(tokens))
    held = [masked, *(v for _, v in tokens if "__" in v)]
    odd = any(joined.search(x) or any(stem in names.sub(" ", x) for stem in stems) for x in held)
    return _put_back(masked, tokens) if odd or any(stem in out for stem in stems) else out


def restored(masked: Column, tokens: Column) -> Column:
    """The text with each token's value put back, the last first: a later token's value may hold an earlier token."""
    return _restored(masked, F.transform(tokens, lambda t: t["id"]), F.transform(tokens, lambda t: t["value"]))


@sliced(StringType())
def _restored(masked: str | None, names: list[str] | None, values: list[str] | None) -> str | None:
    return restore(masked, None if names is None else list(zip(names, values, strict=True)))


def masked_event(events: DataFrame, person: str = "patient") -> DataFrame:
    """Events with the person's name hidden and their address, phone and number masked; a null person stays null."""
    p = F.col(person)
    fields = {f.name for f in events.schema[person].dataType.fields}
    new = p.withField("name", F.when(F.col(f"{person}.name").isNotNull(), F.lit("***"))) if "name" in fields else p
    for name in ("email", "phone", "patient_id"):
        if name in fields:
            new = new.withField(name, mask_pii(F.col(f"{person}.{name}")))
    return events.withColumn(person, F.when(p.isNotNull(), new))
