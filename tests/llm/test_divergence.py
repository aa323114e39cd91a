import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from segmill.llm import divergence


def brute(rows, k=200):
    """Every group, pair and term, by Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    of, held, groups = {}, {}, {}
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        of.setdefault(lang, Counter()).update(set(terms))
        held.setdefault(lang, Counter()).update(terms)
        groups.setdefault((lang, source), Counter()).update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in of.items()}

    def shares(lang, count):
        total = sum(count[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in groups.items()}
    q = {lang: shares(lang, c) for lang, c in held.items()}
    out = []
    for lang, source in groups:
        a = p[lang, source]
        pairs = [(other, sum((a[t] - b[t]) ** 2 // b[t] for t in a)) for (x, other), b in p.items() if x == lang and other != source]
        terms = [(t, (a[t] - q[lang][t]) ** 2 // q[lang][t]) for t in a if groups[lang, source][t] and a[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def made(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'äÖé中Zz'[i % 6]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(90)]
    rows = []
    for i in range(240):
        lang, source = ["en", "de", None, "xx"][i % 11 % 4], [None, "a", "b", "B", "ß"][int(rng.integers(5))]
        words = rng.choice(vocabulary, int(rng.integers(0, 40)), p=(w := 1 / np.arange(1, 91)) / w.sum())
        rows.append((" ".join(words) + ["", ".", " 12"][i % 3] if i % 17 else [None, "", " \t"][i % 3], lang, source))
    rows += [("the the the " * 50, "en", "a")] * 90 + [("solitary", "one", "s"), ("", "none", "s"), (None, "none", "t")]
    return rows


SCHEMA = "text string, lang string, source string"


def test_equals_brute_force(spark):
    rows = made()
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), k=5).collect())) == brute(rows, 5)


def test_sums_of_many_groups(spark, monkeypatch):
    """The sparse sums of tasks for many groups, in small steps, equal the dense ones."""
    rows = made(5)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    seen = []
    original = divergence._Sums.__init__

    def sparse(self, groups):
        original(self, groups)
        self.dense = None
        seen.append(groups)

    groups = divergence.Groups([("a", "x", 40), ("a", "y", 9), ("b", "x", 5), ("a", "z", 100)])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a", "a", "b"]), pa.array([["x", "y", "z"], ["z", "x"], ["x"]]), pa.array([[3, 1, 50], [1, 30], [2]])], ["lang", "sources", "counts"])
    holder = type("Holder", (), {"value": groups})

    def sums():
        out = Counter()
        for b in divergence._common_terms(holder)([batch]):
            for i, j, v in zip(*(b[c].to_pylist() for c in "abv"), strict=True):
                out[i, j] += v
        return out

    dense = sums()
    monkeypatch.setattr(divergence._Sums, "__init__", sparse)
    assert sums() == dense and seen
    assert len(rows)


def test_radix_top(spark):
    """Values from 0 to 2^62, many ties, long common prefixes; groups of all sizes."""
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        n = [1, 3, 50, 400, 4000, 9000][g]
        value = np.where(rng.random(n) < 0.5, 7, 2 ** rng.integers(0, 62, n) + rng.integers(0, 3, n)) if g != 5 else np.full(n, 12345)
        rows += [(g, int(v), f"{'same long beginning é' * (i % 2)}{i:05d}") for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "g int, v long, item string").withColumn("extra", F.lit(1))
    got = sorted((r["g"], r["rank"], r["v"], r["item"]) for r in divergence.radix_top(df, ["g"], "v", "item", 20, at_once=25).collect())
    want = []
    for g in range(6):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:20]
        want += [(g, i + 1, v, item) for i, (_, v, item) in enumerate(best)]
    assert got == want
    same = spark.createDataFrame([(1, 5, "x")] * 100, "g int, v long, item string")
    assert [tuple(r) for r in divergence.radix_top(same, ["g"], "v", "item", 3, at_once=10).orderBy("rank").collect()] == [(1, 5, "x", i) for i in (1, 2, 3)]
    assert divergence.radix_top(same.limit(0), ["g"], "v", "item", 3).count() == 0


def test_documents_equal_sql(spark, documents, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, divergence.audit(documents).collect())) == sorted(con.execute(divergence.audit_sql()).fetchall())


def test_edges(spark, edge):
    df = edge.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit(None).cast("string"), "term": F.lit(0), "place": F.lit(1), "total": F.lit(2)})
    got = divergence.audit(df)
    assert sorted(map(tuple, got.collect())) == brute([(r["text"], r["lang"], r["source"]) for r in df.collect()])
    assert divergence.audit(df.limit(0)).count() == 0
