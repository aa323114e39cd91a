"""How far the sources of a language diverge from each other, and by which terms.

Counts of terms are smoothed to whole billionths, p; f(p, q) = floor((p - q)^2 / q). The sum of f over all terms of a pair of
sources is taken sparsely: a term that neither holds gives the same baseline, so only terms that one of them holds are
corrected for, by counts of equal counts; and terms that both hold once more, added up inside tasks. Top terms are found by
radix selection: histograms over value bits narrow each group's k-th value, bytes of the term decide ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

ONE = 1_000_000_000
#: Bytes of terms: letters of ASCII in lower case and all of other characters; every other byte parts them.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Entries of counts that a task holds before it gives them away; bytes of a text split at once; pairs computed at once.
HELD, RUN, PAIRS = 300_000, 1 << 20, 1 << 19


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about a megabyte at a time."""
    plain, at = text.translate(_TERM), 0
    while at < len(plain):
        end = plain.find(b" ", min(len(plain), at + RUN))
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> (lang, source, term, n, docs): occurrences and documents; a term may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = passed = 0

        def given() -> pa.RecordBatch:
            both = np.array([v for d in held.values() for v in d.values()], np.uint64)
            sizes = [len(d) for d in held.values()]
            column = lambda k: pa.array(np.repeat(np.array([g[k] for g in held], object), sizes), pa.string())
            terms = pa.array([t for d in held.values() for t in d], pa.binary()).cast(pa.string())
            return pa.record_batch([column(0), column(1), terms, pa.array((both >> np.uint64(24)).astype(np.int64)), pa.array((both & np.uint64(0xFFFFFF)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])

        for whole in batches:
            for batch in slices(whole):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    count: Counter = Counter()
                    for terms in term_runs(text):
                        count.update(terms)
                    to = held.setdefault((lang, source), {})
                    size -= len(to)
                    for term, n in count.items():
                        # occurrences and documents in one number: fewer than 2**24 documents pass before it is given away
                        to[term] = to.get(term, 0) + (n << 24) + 1
                    size, passed = size + len(to), passed + 1
                    if size > HELD or passed == 1 << 23:
                        yield given()
                        held, size, passed = {}, 0, 0
        if size:
            yield given()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 1) / total), exactly."""
    return F.expr(f"1 + (cast({ONE} as decimal(38,0)) * ({n} + 1)) div ({total})")


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    if len(n) and int(n.max()) >= 9 * ONE:
        n, total = n.astype(object), total.astype(object)
    return (1 + ONE * (n + 1) // total).astype(np.int64)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """Sums by pair of groups, modulo 2^64; rows a batch at a time."""

    def __init__(self, groups: int):
        self.groups = groups
        self.dense = np.zeros(groups * groups, np.int64) if groups <= 1024 else None

    def add(self, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = a * self.groups + b
        if self.dense is not None:
            np.add.at(self.dense, key, v)
        elif len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield self._batch(key[first], np.add.reduceat(v[order], first))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.dense is not None and len(at := np.flatnonzero(self.dense)):
            yield self._batch(at, self.dense[at])

    def _batch(self, key: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array((key // self.groups).astype(np.int32)), pa.array((key % self.groups).astype(np.int32)), pa.array(v)], ["a", "b", "v"])


class Groups:
    """What tasks need of all groups: their place by (lang, source), N + V, the share of a term without occurrences, and each language's groups."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.place = {(lang, source): i for i, (lang, source, _) in enumerate(rows)}
        self.total = np.array([t for _, _, t in rows], np.int64)
        self.zero = 1 + ONE // np.maximum(self.total, 1)
        by: dict[str, list[int]] = {}
        for i, (lang, _, _) in enumerate(rows):
            by.setdefault(lang, []).append(i)
        self.of = [np.array(by[lang], np.int64) for lang, _, _ in rows]

    def __len__(self) -> int:
        return len(self.total)

    def find(self, langs: pa.Array, sources: pa.Array) -> np.ndarray:
        lang, source = pc.dictionary_encode(langs), pc.dictionary_encode(sources)
        n = len(source.dictionary)
        key, back = np.unique(lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy(), return_inverse=True)
        names, of = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        return np.array([self.place[names[k // n], of[k % n]] for k in key.tolist()], np.int64)[back]


def _common_terms(groups) -> object:
    """Rows (lang, sources list, counts list) of terms -> (a, b, v): what pairs that both hold a term differ by from their baselines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = groups.value
        sums = _Sums(len(g))
        for batch in batches:
            sizes = pc.list_value_length(batch.column("sources")).to_numpy().astype(np.int64)
            langs = batch.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            if not len(langs):
                continue
            at = g.find(langs, pc.list_flatten(batch.column("sources")))
            p = _shares(pc.list_flatten(batch.column("counts")).to_numpy().astype(np.int64), g.total[at])
            zero, each, start = g.zero[at], np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            upto, lo = np.cumsum(each), 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
                n = each[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, j = i[i != j], j[i != j]
                yield from sums.add(at[i], at[j], f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j]))
                lo = hi
        yield from sums.rest()

    return run


def _own_terms(groups) -> object:
    """Rows (lang, source, n, times): so many terms have n occurrences in a group -> (a, b, v): what they change in each pair the group is in, were they the other's baseline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = groups.value
        sums = _Sums(len(g))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = g.find(batch.column("lang"), batch.column("source"))
            p, times = _shares(batch.column("n").to_numpy().astype(np.int64), g.total[at]), batch.column("times").to_numpy().astype(np.int64)
            for a in np.unique(at).tolist():
                mine, others = np.flatnonzero(at == a), g.of[a][g.of[a] != a]
                step = max(1, PAIRS // max(1, len(others)))
                for k in range(0, len(mine), step):
                    q, w = p[mine[k : k + step], None], times[mine[k : k + step], None]
                    other, zero = g.zero[others][None, :], g.zero[a]
                    first = ((f(q, other) - f(zero, other)) * w).sum(0)
                    second = ((f(other, q) - f(other, zero)) * w).sum(0)
                    whole = np.full(len(others), a, np.int64)
                    yield from sums.add(np.concatenate([whole, others]), np.concatenate([others, whole]), np.concatenate([first, second]))
        yield from sums.rest()

    return run


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, at_once: int = 4096, bits: int = 16) -> DataFrame:
    """The k rows of each group with the largest values (long, not negative), ties by the item's UTF-8 bytes; with their `rank` from 1.

    Each pass counts a group's candidates by the next bits of their values (7 leading bits first, then 16 at a time) and keeps the
    bucket in which the k-th falls; when values are used up, by two bytes of the item at a time. A group ends when at most
    `at_once` rows (or k) are left at and above its bucket; those are sorted. Rows that agree in value and item all count; which of them
    get the last ranks is open. No group is gathered; a pass has at most 2**16 + 257 counts a group.
    """
    at_once = max(at_once, k)
    keys, name = rows.select(*group).columns, "_v"
    base = rows.select("*", F.col(value).cast("long").alias("_v"), F.encode(F.col(item), "utf-8").alias("_b"))
    order = Window.partitionBy(*keys)

    def narrowed(counts: DataFrame, by: list[Column], kept: list[str]) -> DataFrame:
        """The bucket of each group in which the k-th row falls; the last one if it has fewer."""
        upto = counts.select("*", (F.col("above") + F.sum("n").over(order.orderBy(*by))).alias("upto"))
        of = upto.where(F.col("upto") - F.col("n") < k)
        last = of.groupBy(*keys).agg(F.max_by(F.struct(*kept, "n", "upto"), "upto").alias("s")).select(*keys, "s.*")
        return last.select(*keys, *kept, (F.col("upto") - F.col("n")).alias("above"), (F.col("upto") <= at_once).alias("done"))

    shift = F.greatest(F.length(F.bin(name)) - 7, F.lit(0))
    first = base.select(*keys, shift.alias("shift"), F.expr(f"shiftright({name}, greatest(length(bin({name})) - 7, 0))").alias("prefix"))
    counts = first.groupBy(*keys, "shift", "prefix").agg(F.count("*").alias("n")).withColumn("above", F.lit(0).cast("long"))
    state = narrowed(counts, [F.desc("shift"), F.desc("prefix")], ["shift", "prefix"])
    none = F.lit(None).cast("binary").alias("upto")
    state = written(state.select("*", none), "state")
    low = F.expr("shiftleft(prefix, shift)")
    left = written(base.join(state.select(*keys, low.alias("_low")), keys).where(F.col(name) >= F.col("_low")).drop("_low"), "candidates")
    while not (open_ := state.where("not done and shift > 0")).isEmpty():
        inside = left.select(*keys, name).join(open_, keys).where(F.expr(f"shiftright({name}, shift) = prefix"))
        finer = inside.select(*keys, "above", F.greatest(F.col("shift") - bits, F.lit(0)).alias("to"), name).select(*keys, "above", F.col("to").alias("shift"), F.expr(f"shiftright({name}, to)").alias("prefix"))
        counts = finer.groupBy(*keys, "above", "shift", "prefix").agg(F.count("*").alias("n"))
        now = narrowed(counts, [F.desc("prefix")], ["shift", "prefix"]).select("*", none)
        state = written(state.where("done or shift = 0").unionByName(now), "state")
    while not (open_ := state.where("not done")).isEmpty():
        mine = (F.col(name) == F.col("prefix")) & (F.col("upto").isNull() | (F.expr("substring(_b, 1, length(upto))") == F.col("upto")))
        inside = left.select(*keys, name, "_b").join(open_, keys).where(mine)
        longer = inside.select(*keys, "above", "prefix", F.coalesce(F.length("upto"), F.lit(0)).alias("had"), F.expr("substring(_b, 1, coalesce(length(upto), 0) + 2)").alias("upto"))
        counts = longer.groupBy(*keys, "above", "prefix", "had", "upto").agg(F.count("*").alias("n")).withColumnRenamed("upto", "bytes")
        now = narrowed(counts, [F.asc("bytes")], ["prefix", "had", "bytes"])
        # an item that gets no longer is all that its bucket holds
        now = now.select(*keys, F.lit(0).alias("shift"), "prefix", "above", (F.col("done") | (F.length("bytes") < F.col("had") + 2)).alias("done"), F.col("bytes").alias("upto"))
        state = written(state.where("done").unionByName(now), "state")
    bound = state.select(*keys, low.alias("_low"), F.col("upto").alias("_upto"))
    within = (F.col(name) > F.col("_low")) | ((F.col(name) == F.col("_low")) & (F.col("_upto").isNull() | (F.expr("substring(_b, 1, length(_upto))") <= F.col("_upto"))))
    best = left.join(bound, keys).where(within)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(name), F.asc("_b"))))
    return ranked.where(F.col("rank") <= k).select(*rows.columns, "rank")


def audit(docs: DataFrame, k: int = 200, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the sum of f over a language's kept terms against each other source of
    it, all ranks; part `term`: the k terms of the source with the largest f against the whole language, of those it
    holds more often than the language.

    Kept are terms in at least least_docs rows of a language. Null text, lang and source count as ''. Repeated rows count each;
    ties go by UTF-8 bytes; a language without kept terms has pairs of value 0, a single source has none; other columns are ignored; an
    empty table gives no rows. Tasks get the list of (language, source) groups: the result holds its square within a language.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counts = term_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    terms = written(terms.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", F.col("of.source").alias("sources"), F.col("of.n").alias("counts")), "terms")
    each = terms.select("lang", "term", "lang_n", F.explode(F.arrays_zip("sources", "counts")).alias("of")).select("lang", "term", "lang_n", F.col("of.sources").alias("source"), F.col("of.counts").alias("n"))
    times = written(each.groupBy("lang", "source", "n").agg(F.count("*").alias("times")), "times")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = times.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    groups = named.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "groups")

    spark = docs.sparkSession
    rows = sorted((r.lang, r.source, r.total + r.v) for r in groups.collect())
    places = spark.createDataFrame([(lang, source, i) for i, (lang, source, _) in enumerate(rows)], "lang string, source string, place int")
    shared = spark.sparkContext.broadcast(Groups(rows))
    parts = terms.select("lang", "sources", "counts").mapInArrow(_common_terms(shared), "a int, b int, v long").unionByName(times.mapInArrow(_own_terms(shared), "a int, b int, v long"))
    sums = parts.groupBy("a", "b").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    ends = groups.join(places, ["lang", "source"]).select("lang", "source", "place", "v", F.when(F.col("v") > 0, F.expr(f"1 + {ONE} div (total + v)")).otherwise(1).alias("zero"))
    a, b = ends.select("lang", "source", "v", F.col("place").alias("a"), F.col("zero").alias("p")), ends.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("q"))
    both = a.join(b, "lang").where("a <> b").join(sums.withColumnRenamed("v", "rest"), ["a", "b"], "left")
    # sums of parts are kept modulo 2^64; the whole fits
    both = both.withColumn("t", F.expr("pmod(cast(v as decimal(19,0)) * cast(((p - q) * (p - q)) div q as decimal(19,0)) + coalesce(rest, 0), 18446744073709551616)"))
    value = F.expr("cast(case when t >= 9223372036854775808 then t - 18446744073709551616 else t end as bigint)")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))

    known = each.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total + v").alias("p"), share("lang_n", "lang_total + v").alias("q"))
    scored = known.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = radix_top(scored, ["lang", "source"], "value", "item", k)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def audit_sql(k: int = 200, least_docs: int = 3) -> str:
    """The same in DuckDB SQL: dense, over every group, pair and kept term."""
    return f"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + ({ONE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v))::HUGEINT AS p
      FROM g JOIN l USING (lang) JOIN (SELECT lang, term FROM kept) USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + ({ONE}::HUGEINT * (kept.n + 1)) // (l.n + l.v))::HUGEINT AS q FROM kept JOIN l USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= {k}"""
