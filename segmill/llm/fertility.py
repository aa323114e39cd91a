"""Quality rules by tokeniser fertility: how a text falls apart under public vocabularies.

Two vocabularies take each word by itself: pieces with byte fallback, and byte pairs. Symbols glued to words, tables of rare
words or another language than the label says shift characters per token; letters a vocabulary lacks show as byte fallback;
lists and chants have little entropy of tokens. What is usual depends on the language and on the length, so the bands of
acceptance are fences around the quartiles of each language (or script, where a language is rare) and length class, counted
over all documents that pass the base rules, equal measurements once.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

SYMBOLS = b"#*$%&|<>"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_NO_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_NO_CHARACTER = bytes(set(range(0x80, 0xC0)) | set(_SPACES))
#: Words of more code points are encoded in stretches of this many.
STRETCH = 1024
#: Words whose encoding a task keeps, and their bytes.
KEPT_WORDS, KEPT_BYTES = 400_000, 16 << 20
#: First code points of ranges, and the script that each range counts as.
STARTS = [0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD800, 0x20000, 0x30000]
SCRIPTS = ["latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "han", "kana", "han", "hangul", "han", "han", "other", "hangul", "other", "han", "other"]
NAMES = sorted(set(SCRIPTS))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_fallback long, n_pairs long, entropy long, script string"


def script_of(word: str) -> int:
    """Index in NAMES of the script of the word's first letter; 'other' if it has none."""
    for c in word:
        if c.isalpha():
            at = bisect_right(STARTS, ord(c)) - 1
            return NAMES.index(SCRIPTS[at] if at >= 0 else "other")
    return NAMES.index("other")


class Encoded:
    """Distinct words under both vocabularies; forgets all when it holds too many."""

    def __init__(self, pieces: str, pairs: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(pairs, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.tokens, self.ends, self.n_pairs, self.script = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the tables."""
        new = list(set(words).difference(self.at))
        if len(self.at) + len(new) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.forget()
            new = list(set(words))
        if new:
            text = [w.decode("utf-8", "replace") for w in new]
            parts = [[t] if len(t) <= STRETCH else [t[i : i + STRETCH] for i in range(0, len(t), STRETCH)] for t in text]
            flat = [p for ps in parts for p in ps]
            owner = np.repeat(np.arange(len(new)), [len(ps) for ps in parts])
            encoded = self.pieces.encode(flat, num_threads=1)
            n = np.bincount(owner, [len(e) for e in encoded], len(new)).astype(np.int64)
            self.tokens = np.concatenate([self.tokens, np.fromiter((i for e in encoded for i in e), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.n_pairs = np.concatenate([self.n_pairs, np.bincount(owner, [len(self.pairs.encode_ordinary(p)) for p in flat], len(new)).astype(np.int64)])
            self.script = np.concatenate([self.script, np.fromiter(map(script_of, text), np.int8, len(text))])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.held += sum(map(len, new))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


@cache
def encoder(pieces: str, pairs: str, pattern: str) -> Encoded:
    """One for all tasks of a worker."""
    return Encoded(pieces, pairs, pattern)


def _repeated(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 3) -> np.ndarray:
    """Of each document, the words in windows of `width` words that it holds twice or more."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(n_docs, np.int64)
    key = doc[:n]
    for k in range(width):
        # pairs of (what came before, the next word) are numbered anew, so keys stay below the square of the words of a batch
        key = np.unique(key * (words.max() + 1) + words[k : n + k], return_inverse=True)[1]
    whole = doc[:n] == doc[width - 1 :]
    count = np.bincount(key[whole], minlength=1)
    twice = whole & (count[np.minimum(key, len(count) - 1)] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return np.bincount(doc[covered], minlength=n_docs)


def _entropy(tokens: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Of each document, the entropy of its tokens in thousandths of a bit, rounded down."""
    key = np.sort(doc * size + tokens)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count, of = np.diff(first, append=len(key)), key[first] // size
    share = count / np.bincount(doc, minlength=n_docs)[of]
    return np.floor(1000 * np.bincount(of, -share * np.log2(share), n_docs) + 1e-9).astype(np.int64)


def measure(texts: list[bytes], encoded: Encoded) -> dict[str, np.ndarray]:
    """The columns of MEASURES for each text."""
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    n, doc = len(texts), np.repeat(np.arange(len(texts)), n_words)
    words = encoded([w for ws in split for w in ws])
    n_tokens = np.diff(encoded.ends)[words]
    first = np.cumsum(n_tokens) - n_tokens
    tokens = encoded.tokens[np.repeat(encoded.ends[:-1][words] - first, n_tokens) + np.arange(n_tokens.sum())]
    token_doc = np.repeat(doc, n_tokens)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    scripts = np.bincount(doc * len(NAMES) + encoded.script[words], minlength=n * len(NAMES)).reshape(n, len(NAMES))
    scripts[:, NAMES.index("other")] = 0
    scripts[:, NAMES.index("other")] = scripts.sum(1) == 0
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t.translate(None, _NO_CHARACTER)) for t in texts], np.int64),
        "n_symbols": np.array([len(t.translate(None, _NO_SYMBOL)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(words, doc, n),
        "n_tokens": np.bincount(token_doc, minlength=n),
        "n_fallback": np.bincount(token_doc[encoded.is_byte[tokens]], minlength=n),
        "n_pairs": np.bincount(doc, encoded.n_pairs[words], n).astype(np.int64),
        "entropy": _entropy(tokens.astype(np.int64), token_doc, n, encoded.size),
        "script": np.array(NAMES, object)[np.argmax(scripts, 1)],
    }


def measured(docs: DataFrame, pieces: str, pairs: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, and MEASURES) of every whole text, a row per row of docs. Null texts count as empty. entropy: thousandths of a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(pieces, pairs, pattern)
        for whole in batches:
            for batch in slices(whole):
                got = measure([t or b"" for t in batch.column("text").to_pylist()], encoded)
                yield pa.record_batch([batch.column("id"), batch.column("lang"), *(pa.array(v) for v in got.values())], ["id", "lang", *got])

    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, {MEASURES}")


def _thousandths(a: str, b: str) -> Column:
    """1000 * a / b rounded down, at most 64,000; null where b is 0."""
    return F.when(F.col(b) > 0, F.least(F.expr(f"(1000 * {a}) div {b}"), F.lit(64_000)))


#: Measured in thousandths: characters per piece, characters per byte-pair token, bits of entropy, byte tokens per piece.
FENCED = ["per_piece", "per_pair", "entropy", "fallback"]


def _fenced() -> list[Column]:
    return [c.alias(n) for n, c in zip(FENCED, (_thousandths("word_chars", "n_tokens"), _thousandths("word_chars", "n_pairs"), F.col("entropy"), _thousandths("n_fallback", "n_tokens")), strict=True)]


def bands(rows: DataFrame, reach: float = 2.25, slack: float = 0.02, least: int = 40) -> DataFrame:
    """(lang, script, length, <name>_low, <name>_high for each of FENCED): what a document may measure; null: no bound.

    rows: of measured(), with columns FENCED and length. The bounds lie `reach` interquartile ranges (at least `slack` of the
    median) outside the quartiles of the language's documents of that length class; where these are fewer than `least`, of the
    script's; where these are too, there are none. Rows with the same measurements count once, so copies don't narrow a
    band. Quartiles come from counts per thousandth, so a group is at most 64,001 counts however many documents it has.
    """
    names = FENCED
    points = rows.select("lang", "script", "length", "n_tokens", *names).where("n_tokens > 0").distinct()
    level = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("key")), F.struct(F.lit(1).alias("level"), F.col("script").alias("key"))))
    point = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v")) for c in names)))
    flat = points.select(level.alias("l"), "length", *names).select("l.*", "length", point.alias("p")).select("level", "key", "length", "p.*").where("key is not null and key <> ''")
    counts = flat.groupBy("level", "key", "length", "name", "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy("level", "key", "length", "name")
    upto = counts.select("*", F.sum("n").over(group.orderBy("v")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("v")))
    quart = upto.groupBy("level", "key", "length", "name").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("total").alias("total"))
    margin = F.greatest(reach * (F.col("q3") - F.col("q1")), slack * F.col("q2"), F.when(F.col("name") == "fallback", F.lit(50.0)).otherwise(0.0))
    fence = quart.where(F.col("total") >= least).select("level", "key", "length", "name", (F.col("q1") - margin).alias("low"), (F.col("q3") + margin).alias("high"))
    pick = lambda c, of: F.max(F.when(F.col("name") == c, F.col(of))).alias(f"{c}_{of}")
    wide = written(fence.groupBy("level", "key", "length").agg(*(pick(c, of) for c in names for of in ("low", "high"))), "bands")
    bounds = [f"{c}_{of}" for c in names for of in ("low", "high")]
    groups = points.select("lang", "script", "length").distinct()
    by = lambda level, key: wide.where(F.col("level") == level).select(F.col("key").alias(key), "length", F.struct(*bounds).alias(f"by_{key}"))
    return groups.join(by(0, "lang"), ["lang", "length"], "left").join(by(1, "script"), ["script", "length"], "left").select("lang", "script", "length", F.coalesce("by_lang", "by_script").alias("b")).select("lang", "script", "length", "b.*")


def rules(docs: DataFrame, pieces: str, pairs: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kept) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, FENCED): a row per row of docs.

    pieces: a sentencepiece model with byte fallback; pairs: a rank file for tiktoken, pattern its split pattern; further
    arguments go to bands(). base_failed: fewer than 50 words, or over half of them in 3-word windows that the text holds
    twice. kept: not base_failed, and characters per token of both vocabularies and entropy not below, byte fallback not above the
    band of language and length class (floor of log4 of the pieces). More characters per token than usual are no fault: the
    vocabulary knows the words. Null and blank texts have no words and fail. A null or empty language is judged by script. Null ids and repeated rows each give a row; other columns are ignored;
    an empty table gives no rows.
    """
    raw = written(measured(docs, pieces, pairs, pattern, id_col, text_col, lang_col), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    length = F.expr("(length(bin(greatest(n_tokens, 1))) - 1) div 2")
    rows = raw.select("id", F.coalesce("lang", F.lit("")).alias("lang"), "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *_fenced(), length.alias("length"), failed.alias("base_failed"))
    fences = written(bands(rows.where("not base_failed"), **kept), "fences")
    least = lambda c: F.coalesce(F.col(c) >= F.col(f"{c}_low"), F.lit(True))
    usual = least("per_piece") & least("per_pair") & least("entropy") & F.coalesce(F.col("fallback") <= F.col("fallback_high"), F.lit(True))
    out = rows.join(fences, ["lang", "script", "length"], "left").withColumn("kept", ~F.col("base_failed") & usual)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *FENCED)
