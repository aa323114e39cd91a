import random
from collections import Counter

from pyspark.sql import functions as F

from segmill.llm import suffix_dedup


def brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i : i + span]) for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        dead = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[hash(r[i : i + span])] > 1:
                dead[i : i + span] = b"\1" * span
        spans = sum(dead[i] and not (i and dead[i - 1]) for i in range(len(dead)))
        out.append((bytes(b for b, d in zip(r, dead) if not d), len(r), sum(dead), spans))
    return out


def check(df, span, gram):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], span))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    # by filters, by joins, and by a filter of the first keys alone where these are few
    for filter_keys in (1 << 26, 0, 40):
        got = [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df, span, gram, filter_keys=filter_keys).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(4)
    for _ in range(200):
        names = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))})
        runs = [[] for _ in range(rng.randint(1, 6))]
        for s in names:
            rng.choice(runs).append((s, 1))
        out = list(suffix_dedup.merged([suffix_dedup.unpacked(suffix_dedup.front_coded(r)) for r in runs]))
        assert [s for s, *_ in out] == names
        assert [i for _, i, _ in out[1:]] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(names, names[1:])]


def test_random_texts_with_planted_repeats(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(15, 90))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + "x" + p[k + 1 :]
            parts += [p, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 30)))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(10)] + [(300 + i, "ab" * 40 + str(i)) for i in range(5)] + [(400, "z" * 90)]
    check(spark.createDataFrame(docs, "doc_id long, text string"), 20, 8)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(2)
    a = "".join(rng.choice("abcd") for _ in range(700))
    texts = [a, "xy" + a[50:600] + "q", a[100:400], "".join(rng.choice("abcd") for _ in range(300))]
    for t in ([x.encode() for x in texts],):
        assert suffix_dedup.anchors(t, 20, 8)["n"].sum() == sum(len(x) - 19 for x in t)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20, 8)


def test_documents(documents):
    check(documents, 200, 100)


def test_edges(edge):
    check(edge.withColumns({"raw": F.lit("clash"), "k1": F.lit(1), "kept": F.lit(2)}), 20, 10)
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0
