from collections import Counter
from math import floor, log2

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from segmill.llm import fertility

FILES = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def encoded():
    return fertility.Encoded(*FILES)


def plain(text, encoded):
    """The measures of one text, word by word."""
    words = (text or "").encode().split()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1}
    lines, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if line.split():
            dup += line in lines
            lines.add(line)
    stretches = [w[i : i + 1024] for w in (w.decode() for w in words) for i in range(0, len(w), 1024)]
    tokens = [t for w in stretches for t in encoded.pieces.encode(w)]
    count = Counter(tokens)
    entropy = -sum(n / len(tokens) * log2(n / len(tokens)) for n in count.values())
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": dup, "n_repeat_words": len(covered), "n_tokens": len(tokens), "n_fallback": sum(encoded.pieces.is_byte(t) for t in tokens),
        "n_pairs": sum(len(encoded.pairs.encode_ordinary(w)) for w in stretches), "entropy": entropy,
    }


TEXTS = [None, "", " \t\n", "one", "a b c a b c a b", "x\ny\nx\n x\n\n\ny", "### ünï|<> 中文 👍🏽 𓀀𓀁 end", "w" * 5000 + " é" * 30, "a\x1cb c\x0bd\x0c", "same line\n" * 20, "the cat sat " * 40]


def test_measures_equal_plain_counts(encoded, documents):
    texts = TEXTS + [r["text"] for r in documents.limit(60).collect()]
    got = fertility.measure([(t or "").encode() for t in texts], encoded)
    for i, t in enumerate(texts):
        want = plain(t, encoded)
        assert {c: int(got[c][i]) for c in want if c != "entropy"} == {c: v for c, v in want.items() if c != "entropy"}
        assert abs(got["entropy"][i] - 1000 * want["entropy"]) <= 1.001


def test_forgetting_words_changes_nothing(encoded, documents, monkeypatch):
    texts = [(r["text"] or "").encode() for r in documents.limit(40).collect()]
    want = fertility.measure(texts, encoded)
    monkeypatch.setattr(fertility, "KEPT_WORDS", 50)
    small = fertility.Encoded(*FILES)
    for t in range(len(texts)):
        got = fertility.measure(texts[t : t + 1], small)
        assert all(got[c][0] == want[c][t] for c in want)


def test_scripts():
    words = {"word": "latin", "слово": "cyrillic", "λέξη": "greek", "漢字": "han", "かな": "kana", "한글": "hangul", "عربي": "arabic", "עברית": "hebrew", "हिंदी": "indic", "ไทย": "thai", "123": "other", "(é": "latin", "ﬁ": "other"}
    assert {w: fertility.NAMES[fertility.script_of(w)] for w in words} == words


def test_verdicts_equal_plain_bands(spark, documents, encoded):
    """Quartiles of distinct measurements by language and length, by script where these are few, none where those are too."""
    df = documents.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 9 == 1, "rare").otherwise(F.col("lang")))
    df = df.unionByName(df.limit(30)).unionByName(spark.createDataFrame([(9000 + i, "中文 " * 30 + f"{i} " * (30 + i), "zh", "s", 1) for i in range(5)], df.schema))
    got = sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in fertility.rules(df, *FILES, least=15).collect())
    rows = []
    for r in df.collect():
        m = {c: v[0] for c, v in fertility.measure([(r["text"] or "").encode()], encoded).items()}
        n, chars = int(m["n_tokens"]), int(m["word_chars"])
        v = {"per_piece": 1000 * chars // n, "per_pair": 1000 * chars // int(m["n_pairs"]), "entropy": int(m["entropy"]), "fallback": 1000 * int(m["n_fallback"]) // n} if n else {}
        rows.append((r["doc_id"], r["lang"] or "", m["script"], floor(log2(max(n, 1)) / 2), bool(m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]), n, v))
    fences = {}
    for level in (1, 2):
        groups = {}
        for x in {(r[1], r[2], r[3], r[5], tuple(r[6].items())) for r in rows if not r[4]}:
            if x[level - 1]:
                groups.setdefault((level, x[level - 1], x[2]), []).append(dict(x[4]))
        for key, found in groups.items():
            if len(found) >= 15:
                for c in fertility.FENCED:
                    values = sorted(v[c] for v in found)
                    q1, q2, q3 = (values[int(np.ceil(s * len(values))) - 1] for s in (0.25, 0.5, 0.75))
                    margin = max(2.25 * (q3 - q1), 0.02 * q2, 50 if c == "fallback" else 0)
                    fences[key, c] = (q1 - margin, q3 + margin)
    want = []
    for i, lang, script, length, failed, _, v in rows:
        key = next((k for k in ((1, lang, length), (2, script, length)) if (k, "entropy") in fences), None)
        inside = key is None or all(v[c] <= fences[key, c][1] if c == "fallback" else v[c] >= fences[key, c][0] for c in v)
        want.append((i, failed, not failed and inside))
    assert got == sorted(want)
    assert sum(k for _, f, k in got) > 0.7 * sum(not f for _, f, _ in got)


def test_labelled_documents(spark):
    """Documents labelled as good stay, most of the others go."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = fertility.rules(docs, *FILES).join(labels, "doc_id").where("not base_failed")
    got = {r["quality"]: (r["n"], r["kept"]) for r in out.groupBy("quality").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1][1] > 0.995 and got[0][1] < 0.2


PROSE = "The old harbour lay quiet in the early morning, and only the gulls were awake. A fisherman mended his nets by the wall while his daughter counted the boats that had come back during the night. She knew each of them by its colour, and she called out their names one after the other until her father laughed and told her to save some breath for school. Later, when the sun had climbed above the warehouses, the market opened and people came from every street of the town to buy fish, bread and flowers."


def test_clean_prose_of_another_kind_stays(spark, documents):
    """Plain prose, whose words the vocabularies know better than those of the documents around it, is kept."""
    own = spark.createDataFrame([(-1, PROSE, "en", "s", 1), (-3, PROSE.replace(" ", "\n"), "en", "s", 1)], documents.schema)
    kept = {r["doc_id"]: r["kept"] for r in fertility.rules(documents.unionByName(own), *FILES).where("doc_id < 0").collect()}
    assert kept[-1] and kept[-3]


def test_edges(edge):
    df = edge.withColumns({"lang": F.lit(None).cast("string"), "length": F.lit(1), "script": F.lit("x"), "kept": F.lit(1), "n_words": F.lit(0)})
    got = fertility.rules(df, *FILES)
    assert got.count() == edge.count() and got.where("n_words = 0 and (kept or not base_failed)").count() == 0
    assert fertility.rules(df.limit(0), *FILES).count() == 0
