import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segmill.llm import token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def brute(rows):
    t = Tokenizer.from_file(FILE)
    out, start = [], 0
    rows = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    for i, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_documents(documents):
    assert rows(token_files.token_files(documents, FILE)) == brute([tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_many_shards(documents, tmp_path):
    manifest = token_files.write_token_files(documents, str(tmp_path), FILE, shard_chars=20_000)
    assert manifest.count() > 10
    got = rows(token_files.read_token_files(manifest, str(tmp_path)))
    assert got == brute([tuple(r) for r in documents.select("doc_id", "text").collect()])
    flat = np.concatenate([np.fromfile(p, np.uint16) for p in sorted(tmp_path.glob("*.bin"))])
    assert len(flat) == got[-1][1] + got[-1][2]


def test_edges(edge):
    assert rows(token_files.token_files(edge, FILE)) == brute([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert token_files.token_files(edge.limit(0), FILE).count() == 0


def test_hot_ids_are_cut(spark, tmp_path):
    """One id and one text hold most rows: they still spread over shards."""
    docs = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit("the same words in every row").alias("text"))
    manifest = token_files.write_token_files(docs, str(tmp_path), FILE, shard_chars=10_000)
    assert manifest.count() > 8 and manifest.agg(F.max("n_docs")).first()[0] < 1500
    got = rows(token_files.read_token_files(manifest, str(tmp_path)))
    assert [r[0] for r in got] == sorted(r[0] for r in docs.collect())


def _differing(texts):
    """Texts of which encode() gives other ids than the tokenizer does for the whole text."""
    t = Tokenizer.from_file(FILE)
    ids, counts = token_files.encode(pa.array(texts, pa.string()), token_files.encoder(FILE), 2)
    ends = np.cumsum(counts)
    want = t.encode_batch(texts, add_special_tokens=False)
    return [x for x, e, n, w in zip(texts, ends, counts, want, strict=True) if ids[e - n : e].tolist() != [*w.ids, 2]]


def test_every_letter_before_a_mark():
    """Letters that decompose (U+0130, U+0958, U+FB2A ...) join a mark behind them; all others stay apart."""
    letters = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c))[0] in "LM" and not 0xAC00 <= c < 0xD7A4 and not 0x3400 <= c < 0x9FFF and c < 0x20000]
    assert {"İ", "क़", "שׁ"} <= set(letters)
    assert _differing([f"{c}. a{c}, {c.upper()}b." for c in letters]) == []


def test_plain_words():
    """Each plain letter by each mark, in either case, in the middle and at the end of a word."""
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    assert _differing([" ".join(f"{a}{m} x{a}{m}{m} {a}{m}{a}" for m in MARKS) for a in letters]) == []
    assert _differing([f"abc{a}{b} Éx{a}{b}{a}" for a in MARKS for b in MARKS]) == []


def test_random_texts():
    rng = np.random.default_rng(2)
    alphabet = [*"aBcéÉßİıſΣςάक़ड़שׁ가ㄱ̸́ͅ'’.,!?-_()<>|0123½²№ªº  \x1c\x85 \n\t\v", "<|endoftext|>", "'s", "'LL", "ﬁ", "Ǆ", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(20_000)]
    assert _differing(texts) == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="apart"):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
