import itertools
import random

import xxhash
from pyspark.sql import functions as F

from segmill.llm import simhash


def brute(rows):
    fps = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append((i, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps)), key=str)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_masks_cover_every_pair_of_bits():
    masks = simhash.masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = rows(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    assert sorted(found) == [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]


def test_documents(documents):
    got = simhash.near_duplicates(documents)
    assert sorted(rows(got), key=str) == brute(rows(documents.select("doc_id", "text")))


def test_edges(spark, edge):
    got = sorted(rows(simhash.near_duplicates(edge)), key=str)
    assert got == brute(rows(edge.select("doc_id", "text")))
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab c d")).alias("h")).first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"ab c d", 42)


def kept_by_brute_force(rows, similarity=0.8, width=5):
    """Rows (id, text) that stay: the first of each component of Jaccard links."""
    words = [tuple((t or "").encode().lower().split()) for _, t in rows]
    sets = [{w[k : k + width] for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if words[a] == words[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
            root[find(b)] = find(a)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(find(k), []).append((i is None, i or 0, t or ""))
    return sorted((min(g)[:2] for g in groups.values()), key=str)


def ids(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()), key=str)


def variants(rng, n, base, share):
    """n texts that have `share` of the words of base replaced, at random places."""
    out = []
    for _ in range(n):
        words = base[:]
        for k in rng.sample(range(len(words)), int(share * len(words))):
            words[k] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def texts_with_groups(seed):
    rng = random.Random(seed)
    texts = []
    for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
        for size in (40, 120, 400):
            base = [f"v{rng.randrange(3000)}" for _ in range(size)]
            texts += [" ".join(base), *variants(rng, 6, base, share)]
    return [(i, t) for i, t in enumerate(texts + texts[:5])]


def test_keep_one_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and ids(got) == kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_keep_one_of_variants(spark):
    rows = texts_with_groups(1)
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = kept_by_brute_force(rows)
    assert ids(got) == want and len(want) < 0.8 * len(rows)


def test_keep_one_in_split_buckets(spark, monkeypatch):
    """Buckets that are compared block by block give the same groups."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*variants(rng, 150, base, 0.02), *variants(rng, 60, base, 0.01)])]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ids(got) == kept_by_brute_force(rows)


def test_keep_one_edges(spark, edge):
    got = simhash.keep_one(edge)
    assert got.columns == edge.columns and ids(got) == kept_by_brute_force([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert simhash.keep_one(edge.limit(0)).count() == 0
    # one id with different texts: no row is lost; ties of equal rows leave one
    far = "entirely different words stand here and nothing is common"
    rows = [(1, "a text of its own with several words in it", "x"), (1, far, "y"), (1, far, "z"), (2, far.upper(), "y"), (None, far, "n"), (None, "only here", "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", rows[0][1]), ("1", far), ("None", "only here")])


def test_long_texts_are_read_in_runs():
    text = " ".join(f"Word{i % 9973}" for i in range(60_000)).encode()
    words = text.lower().split()
    for width in (1, 3, 5):
        runs = list(simhash.word_runs(text, width, 1000))
        assert len(runs) > 50
        assert [tuple(r[k : k + width]) for r in runs for k in range(len(r) - width + 1)] == [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    assert list(simhash.word_runs(b"  A b ", 5)) == [[b"a", b"b"]] and list(simhash.word_runs(b" \t ", 3)) == [] and list(simhash.word_runs(b"", 3)) == []
    assert simhash.candidate_keys(b" ", 5, 2, 20, 5) == [] and len(simhash.candidate_keys(text, 5, 2, 20, 5)) == 27
