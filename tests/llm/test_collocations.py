import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import collocations


def brute(rows, k=2000, least=30):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3, 4):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    often = {p: a for p, a in count.items() if a >= least}
    found = {}
    for (lang, words), a in often.items():
        if len(words) > 1:
            cuts = [(2000000 * a // (count[lang, words[:c]] + count[lang, words[c:]]), c, count[lang, words[:c]], count[lang, words[c:]]) for c in range(1, len(words))]
            found[lang, words] = (a, *min(cuts))
    gone = set()
    for lang, words in found:
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                if 100 * often[lang, words] >= 80 * often[lang, words[i : i + n]]:
                    gone.add((lang, words[i : i + n]))
    out = []
    for lang in total:
        best = sorted(((-s, -a, " ".join(w).encode(), a, left, right) for (x, w), (a, s, _, left, right) in found.items() if x == lang and (x, w) not in gone))[:k]
        out += [(lang, i + 1, p.decode(), a, left, right, total[lang], -s) for i, (s, _, p, a, left, right) in enumerate(best)]
    return sorted(out)


def made():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)] + ["É", "\x00\x1f", "x\x1cy"]
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 60))
        text = "".join(w + str(rng.choice([" ", "\t", "  ", ". ", ";\n", "\r\x0b", ""], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for w in rng.choice(words, n))
        rows.append((text + (" In The Long Run we say" if i % 3 else " in the long, run"), ["en", None, "de", "und"][i % 4]))
    return rows + [("knock knock knock knock knock", "")] * 40 + [(None, "en"), ("", None), (" \t ", "de"), ("...!", "de"), ("a", "alone")]


SCHEMA = "text string, lang string"


@pytest.mark.parametrize("bits", [None, 14])
def test_equals_brute_force(spark, bits):
    """Also with so few buckets that many of them are shared."""
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, collocations.collocations(df, bits=bits).collect())) == brute(rows)
    assert sorted(map(tuple, collocations.collocations(df, k=7, bits=bits).collect())) == brute(rows, 7)


def test_long_texts_in_runs(spark, monkeypatch):
    """Cuts between runs lose no phrase and count none twice; tasks that forget words and give counts away early count the same."""
    rng = np.random.default_rng(9)
    text = " ".join(rng.choice(["to", "be", "or", "not,", "that", "is."], 4000).tolist())
    want = list(collocations.word_runs([text.encode()] * 2, 0))
    monkeypatch.setattr(collocations, "RUN", 100)
    for overlap in (0, 1, 3, 4):
        runs = list(collocations.word_runs([text.encode()] * 2, overlap))
        assert len(runs) > 100 and sum((words[old:] for words, old in runs), []) == want[0][0]
        assert all(before[0][len(before[0]) - now[1] :] == now[0][: now[1]] for before, now in zip(runs, runs[1:], strict=False))
    assert list(collocations.word_runs([], 3)) == []


def test_filters_pass_all_frequent_phrases(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).fillna("und", ["lang"]).fillna("", ["text"])
    known, totals = collocations.frequent(df, longest=3, least=5, bits=15)
    got = {(r["lang"], r["phrase"]): r["a"] for r in known.collect()}
    count = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    count["und" if lang is None else lang, " ".join(words[i : i + n])] += 1
    assert got == {p: a for p, a in count.items() if a >= 5} and totals.count() == 5


def test_documents_equal_sql(spark, documents, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted(map(tuple, collocations.collocations(documents).collect()))
    assert got == sorted(con.execute(collocations.collocations_sql()).fetchall()) and len(got) > 10


def test_edges(edge):
    df = edge.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "phrase": F.lit(0), "size": F.lit(1), "a": F.lit(2)})
    assert sorted(map(tuple, collocations.collocations(df).collect())) == brute([(r["text"], r["lang"]) for r in df.collect()])
    assert collocations.collocations(df.limit(0)).count() == 0
