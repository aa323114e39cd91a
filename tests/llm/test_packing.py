import random
from collections import defaultdict

from pyspark.sql import functions as F

from segmill.llm import packing


def brute(sizes, sources, clusters, capacity, per_source):
    """Best fit by trying every bin."""
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(bins)) if bins[b][0] >= sizes[i] and bins[b][1].count(sources[i]) < per_source + (sources[i] < 0) * 10**9 and (clusters[i] < 0 or clusters[i] not in bins[b][2])]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], b))
        else:
            bins.append([capacity, [], []])
            b = len(bins) - 1
        out[i] = b, capacity - bins[b][0]
        bins[b] = [bins[b][0] - sizes[i], bins[b][1] + [sources[i]], bins[b][2] + [clusters[i]]]
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 40)
        args = [rng.randint(1, 50) for _ in range(n)], [rng.randint(-1, 3) for _ in range(n)], [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)], 60, rng.randint(1, 3)
        assert packing.best_fit(*args) == brute(*args)


def check(docs, got, capacity, per_source):
    want = {}
    n_rows = 0
    for r in docs.collect():
        n_rows += 1
        want[r["doc_id"]] = len((r["text"] or "").encode().split()) + 1
    bins, pieces = defaultdict(list), defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        bins[r["bin_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        assert {r["start"] for r in own} == set(range(0, want[i], capacity))
        assert sum(r["n_tokens"] for r in own) % want[i] == 0
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert own[0]["bin_offset"] == 0 and all(a["bin_offset"] + a["n_tokens"] == b["bin_offset"] for a, b in zip(own, own[1:])) and own[-1]["bin_offset"] + own[-1]["n_tokens"] <= capacity
        if len(own) > 1:
            texts = [text[r["doc_id"]] for r in own]
            assert len(set(texts)) == len(texts)
            named = [source[r["doc_id"]] for r in own if source[r["doc_id"]] is not None]
            assert all(named.count(s) <= per_source for s in named)
    return bins


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins = check(docs, packing.pack(docs, group_docs=300).collect(), 2048, 4)
    assert sum(r["n_tokens"] for b in bins.values() for r in b) / 2048 / len(bins) > 0.8


def test_edges(edge):
    docs = edge.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("a"))).withColumn("group", F.lit(1)).withColumn("tokens", F.lit(1))
    check(docs, packing.pack(docs, capacity=100, per_source=1).collect(), 100, 1)
    assert packing.pack(docs.limit(0)).count() == 0
