"""Phrases of two to four words that keep together, found by hashing passes in the manner of PCY and DHP.

Each pass over the texts counts phrases of one length exactly and, into hash buckets, those of the next length. Before a phrase is
counted exactly it has to pass two bounded broadcast filters: the bitmap of buckets that reached the threshold (any phrase that
has is in such a bucket), and a Bloom filter of the frequent phrases one word shorter, which both its ends have to be in
(Apriori). Filters only spare work; counts, and thus results, are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom, in_bloom, mixed, slices, written

#: Bytes: A-Z lower-case, a tab a blank, and 0xFF (in no UTF-8 text) for what ends a piece.
_PLAIN = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_END = b"\xff"
#: Entries that a task holds, bytes of text taken at once, buckets in a chunk, and the least and most bits of a bucket's number.
HELD, RUN, CHUNK = 150_000, 1 << 20, 1 << 14
LEAST_BITS, MOST_BITS = 20, 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_runs(texts: list[bytes], overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and ends of pieces of all texts, about a megabyte at a time; a run opens with the last `overlap` words of the one before, and says how many."""
    held: list[bytes] = []
    parts: list[bytes] = []
    size = 0

    def run() -> tuple[list[bytes], int]:
        nonlocal held, parts, size
        # blanks are all the white space that is left
        new, words = len(held), held + b" ".join(parts).replace(_END, b" \xff ").split()
        held, parts, size = words[len(words) - overlap :] if overlap else [], [], 0
        return words, new

    for text in texts:
        plain, at = text.translate(_PLAIN) + b" " + _END, 0
        while at < len(plain):
            end = plain.find(b" ", min(len(plain), at + RUN - size))
            end = len(plain) if end < 0 else end
            parts.append(plain[at:end])
            size, at = size + end - at, end
            if size >= RUN:
                yield run()
    if parts:
        yield run()


class _Numbers(dict):
    """The number of each word; a new one gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """Numbers, hashes and spellings of the words a task meets. Number 0 ends a piece."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.at = _Numbers({_END: 0})
        self.spelled, self.hash, self.bytes = [_END], np.zeros(1, np.uint64), 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if new := list(islice(self.at, len(self.spelled), None)):
            self.spelled += new
            self.bytes += sum(map(len, new))
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
        return out

    def crowded(self) -> bool:
        return len(self.at) > HELD or self.bytes > 32 << 20


def _hashes(words: np.ndarray, lang: str, n: int) -> list[np.ndarray]:
    """For each length from 1 to n, the hash of the phrase that starts at each place."""
    out = [mixed(words ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 13)))]
    for k in range(1, n):
        out.append(mixed(out[-1][: len(words) - k] * _STEP + words[k:]))
    return out


def _pass(docs: DataFrame, n: int, bits: int, least: int, bitmap, shorter, last: bool) -> DataFrame:
    """One pass: (lang, phrase, key, n, chunk, payload). Rows with a phrase: exact counts of candidates of n words, several a phrase.
    Rows with a chunk: counts of the buckets of n + 1 words, up to `least` each, compressed; none in the last pass."""

    fields = ["lang", "phrase", "key", "n", "chunk", "payload"]

    def counted(lang: str, phrases: list[bytes], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(phrases)
        return pa.record_batch([pa.array([lang] * size, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(n), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        words_held: dict[str, np.ndarray] = {}
        held: dict[str, dict[bytes, list[int]]] = {}
        buckets = None if last else np.zeros(1 << bits, np.uint8)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, tally in words_held.items():
                at = np.flatnonzero(tally)
                yield counted(lang, [known.spelled[i] for i in at.tolist()], _hashes(known.hash[at], lang, 1)[0], tally[at])
            for lang, phrases in held.items():
                values = np.array(list(phrases.values()), np.int64).reshape(-1, 2)
                yield counted(lang, list(phrases), np.ascontiguousarray(values[:, 0]).view(np.uint64), np.ascontiguousarray(values[:, 1]))
            words_held.clear()
            held.clear()

        for whole in batches:
            for batch in slices(whole):
                langs = batch.column("lang").to_pylist()
                texts = batch.column("text").to_pylist()
                for lang in dict.fromkeys(langs):
                    for words, old in word_runs([t for t, x in zip(texts, langs, strict=True) if x == lang], n if not last else n - 1):
                        if known.crowded() or sum(map(len, held.values())) > HELD:
                            yield from given()
                            known.forget()
                        # ends of pieces behind the words, so that phrases of every length have a place
                        at = np.concatenate([known(words), np.zeros(n + 1, np.int64)])
                        hashes = _hashes(known.hash[at], lang, n if last else n + 1)
                        inside = [at != 0]
                        for k in range(1, len(hashes)):
                            inside.append(inside[-1][: len(at) - k] & inside[0][k:])
                        candidate = inside[n - 1]
                        if n > 1:
                            near = in_bloom(shorter.value, hashes[n - 2]) & inside[n - 2]
                            bucket = hashes[n - 1] >> np.uint64(64 - bits)
                            candidate = candidate & near[:-1] & near[1:] & (bitmap.value[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        if not last:
                            longer = np.flatnonzero(inside[n] & candidate[:-1] & candidate[1:])
                            longer = longer[longer + n >= old]
                            number, times = np.unique((hashes[n][longer] >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                            buckets[number] = np.minimum(buckets[number] + np.minimum(times, least), least)
                        places = np.flatnonzero(candidate)
                        places = places[places + n - 1 >= old]
                        if n == 1:
                            tally = np.bincount(at[places], minlength=len(known.spelled))
                            if lang in words_held:
                                tally[: len(words_held[lang])] += words_held[lang]
                            words_held[lang] = tally
                            continue
                        group = at[places]
                        for k in range(1, n):
                            group = np.unique(group, return_inverse=True)[1] * len(known.spelled) + at[places + k]
                        _, first, times = np.unique(group, return_index=True, return_counts=True)
                        starts, phrases = places[first], held.setdefault(lang, {})
                        for i, key, c in zip(starts.tolist(), hashes[n - 1][starts].view(np.int64).tolist(), times.tolist(), strict=True):
                            phrases.setdefault(b" ".join(words[i : i + n]), [key, 0])[1] += c
        yield from given()
        if not last:
            squeeze = zstandard.ZstdCompressor(level=1)
            full = np.flatnonzero(buckets.reshape(-1, CHUNK).any(1)).tolist()
            for i in range(0, len(full), 256):
                part = full[i : i + 256]
                size = len(part)
                payload = [squeeze.compress(buckets[c * CHUNK : (c + 1) * CHUNK].tobytes()) for c in part]
                yield pa.record_batch([pa.nulls(size, pa.string()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], fields)

    return docs.mapInArrow(run, "lang string, phrase string, key long, n long, chunk int, payload binary")


def _bitmap(chunks: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which buckets have reached `least`, a bit each: 2**bits / 8 bytes. Chunks are added up in the order they come, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, sums = zstandard.ZstdDecompressor(), None, None

        def given() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["chunk", "payload"])

        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                if chunk != now:
                    if now is not None:
                        yield given()
                    now, sums = chunk, np.zeros(CHUNK, np.uint8)
                np.minimum(sums + np.frombuffer(open_.decompress(payload.as_buffer()), np.uint8), least, out=sums, casting="unsafe")
        if now is not None:
            yield given()

    tasks = chunks.repartition("chunk").sortWithinPartitions("chunk")
    found = tasks.mapInArrow(run, "chunk int, payload binary").toArrow()
    out = np.zeros((1 << bits) // CHUNK * (CHUNK // 8), np.uint8).reshape(-1, CHUNK // 8)
    for chunk, payload in zip(found["chunk"].to_pylist(), found["payload"].to_pylist(), strict=True):
        out[chunk] = np.frombuffer(payload, np.uint8)
    return out.reshape(-1)


def frequent(docs: DataFrame, longest: int = 4, least: int = 30, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text), without nulls -> (lang, size, phrase, a) of all phrases of 1 to `longest` words with at least `least` occurrences (at
    most 127), and (lang, n): all words.

    bits: of a bucket's number; a bucket for every 16 bytes of text if not given, at most 2**27. With more text buckets fill, and more
    phrases are counted exactly than need be.
    """
    if not 1 <= least <= 127:
        raise ValueError("buckets count up to 127")
    spark = docs.sparkSession
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(size // 16).bit_length()))
    rows = docs.select("lang", F.col("text").cast("binary").alias("text"))
    bitmap = shorter = totals = None
    found = []
    for n in range(1, longest + 1):
        raw = written(_pass(rows, n, bits, least, bitmap, shorter, n == longest), f"pass{n}")
        counted = raw.where("phrase is not null")
        if n == 1:
            totals = written(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        often = written(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.min("key").alias("key")).where(F.col("a") >= least), f"frequent{n}")
        found.append(often.select("lang", F.lit(n).alias("size"), "phrase", "a"))
        if n < longest:
            shorter = spark.sparkContext.broadcast(bloom(often, "key"))
            bitmap = spark.sparkContext.broadcast(_bitmap(raw.where("chunk is not null").select("chunk", "payload"), bits, least))
    return reduce(DataFrame.unionByName, found), totals


def _words(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first if isinstance(first, Column) else F.lit(first), size), " ")


def collocations(docs: DataFrame, k: int = 2000, longest: int = 4, least: int = 30, covered: int = 80, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the k phrases of 2 to `longest` words of each language that keep together best.

    Words are runs without blanks and tabs inside pieces that marks and line ends part; A-Z in lower case. a, l, r: occurrences of the
    phrase, of the part before its weakest cut and of the part behind; n: all words of the language; score: floor(2000000 * a /
    (l + r)) at that cut (the lowest; the first of equal ones). Phrases with a < least are out, and those inside a longer one that has at
    least `covered` percent of their occurrences. Ties by a, then by UTF-8 bytes. Null texts count as empty, a null language
    as `und`; repeated rows count each; other columns are ignored; without phrases there are no rows.
    """
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known, totals = frequent(named, longest, least, bits)
    phrases = known.where("size > 1")
    parts = known.where(F.col("size") < longest).select("lang", "phrase", "a")
    cuts = phrases.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "size", "phrase", "a", "cut", _words(1, F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr("(cast(2000000 as decimal(38,0)) * a) div (l + r)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("w"))

    spans = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: _words(at, m)))
    inner = phrases.where("size > 2").select("lang", F.explode(F.array_distinct(F.flatten(spans))).alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = weakest.join(most, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    flat = free.select("lang", "phrase", "a", "w.l", "w.r", "w.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best k of each of 64 parts of a language, then the best of these: no task sees more than 64 * k rows of one
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = flat.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(k: int = 2000, least: int = 30, covered: int = 80) -> str:
    """The same in DuckDB SQL, without filters: every phrase is counted."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
      FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size))),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= {least}),
cuts AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS cut FROM f WHERE size > 1),
scored AS (SELECT cuts.*, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(words[:cut], ' ')
           JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
free AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.size > s.size AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * f.a >= {covered} * s.a))
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a, l, r, n, score FROM free JOIN n USING (lang) QUALIFY rank <= {k}"""
