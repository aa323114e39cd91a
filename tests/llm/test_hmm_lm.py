import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segmill.llm import hmm_lm

def HELD():  # noqa: N802
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1



def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", lower(text or "")), None]


def brute_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(t for h, (_, x) in zip(held, rows) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for h, (i, x) in zip(held, rows)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 4)]
    for s, got in zip(seqs, hmm_lm.forward(seqs, start, move, emit)):
        total = sum(start[p[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([emit[x, q] for x, q in zip(s, p)]) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_expectations_equal_posteriors_of_all_paths():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T
    seqs = [rng.integers(0, 4, n) for n in (3, 5, 1)]
    counts, moves, starts = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    hmm_lm.expectations(seqs, start, move, emit, counts, moves, starts)
    want_counts, want_moves, want_starts = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        w = np.array([start[p[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([emit[x, q] for x, q in zip(s, p)]) for p in paths])
        for p, q in zip(paths, w / w.sum()):
            want_starts[p[0]] += q
            for x, st in zip(s, p):
                want_counts[x, st] += q
            for a, b in itertools.pairwise(p):
                want_moves[a, b] += q
    assert np.allclose(counts, want_counts) and np.allclose(moves, want_moves) and np.allclose(starts, want_starts)


def test_windows_lose_nothing():
    """Counts and likelihoods of sequences cut into windows are those of whole sequences, in double precision."""
    rng = np.random.default_rng(2)
    start, move, emit = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4) * 0.3, 4), rng.dirichlet(np.ones(50) * 0.2, 4).T + 1e-9
    seqs = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 7, 8, 9, 64, 65, 500, 1203)]

    def expected(window):
        out = np.zeros((50, 4)), np.zeros((4, 4)), np.zeros(4)
        hmm_lm.expectations(seqs, start, move, emit, *out, window=window)
        return out

    for a, b in zip(expected(8), expected(10**6), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    assert np.allclose(hmm_lm.forward(seqs, start, move, emit, 8), hmm_lm.forward(seqs, start, move, emit, 10**6), rtol=1e-10)
    single = np.zeros((50, 4)), np.zeros((4, 4)), np.zeros(4)
    hmm_lm.expectations(seqs, start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32), *single, window=8)
    assert np.allclose(single[1], expected(10**6)[1], rtol=1e-3)


def test_a_million_words():
    rng = np.random.default_rng(3)
    start, move, emit = hmm_lm.initial(np.full(1000, 1e-3), 8)
    text = [rng.integers(0, 1000, 1_000_000).astype(np.uint16)]
    counts, moves, starts = np.zeros((1000, 8)), np.zeros((8, 8)), np.zeros(8)
    hmm_lm.expectations(text, start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32), counts, moves, starts)
    assert math.isclose(counts.sum(), 1e6, rel_tol=1e-3) and math.isclose(moves.sum(), 1e6 - 1, rel_tol=1e-3) and math.isclose(starts.sum(), 1, rel_tol=1e-3)
    assert -7.5e6 < hmm_lm.forward(text, start, move, emit)[0] < -6.5e6


def test_more_classes_than_16_bits(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "a c d", "b a"] * 2)], "doc_id long, text string")
    small, large = (sorted(tuple(r) for r in hmm_lm.score(docs, HELD(), states=2, own=50, buckets=n, rounds=1).collect()) for n in (20, 70_000))
    assert [r[:5] for r in small] == [r[:5] for r in large] and all(np.isfinite(r[6]) for r in large)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm_lm.score(docs, HELD(), own=3000, buckets=500).collect()
    same(got, brute_base([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all texts of two tokens: each own word, each rare word and the unseen one of its class, then the end or more."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "a c d", "b a", "a a b xyz"] * 3)], "doc_id long, text string")
    out = hmm_lm.score(docs, F.lit(False), states=2, own=2, buckets=3, rounds=2)
    words = ["a", "b", "c", "d", "xyz"]
    probes = spark.createDataFrame([(100, "")] + [(101 + i, w) for i, w in enumerate(words)], "doc_id long, text string")
    both = docs.withColumn("held", F.lit(False)).unionByName(probes.withColumn("held", F.lit(True)))
    got = {r["doc_id"]: r["score"] for r in hmm_lm.score(both, F.col("held"), states=2, own=2, buckets=3, rounds=2).collect()}
    assert sum(10 ** got[i] for i in range(100, 106)) < 1
    assert len(out.collect()) == 12


def test_edges(edge):
    got = hmm_lm.score(edge, HELD(), states=3, own=50, buckets=20, rounds=1).collect()
    same(got, brute_base([tuple(r) for r in edge.select("doc_id", "text").collect()]))
    assert all(np.isfinite(r["score"]) for r in got)
    assert hmm_lm.score(edge.limit(0), HELD(), states=2, rounds=1).count() == 0
