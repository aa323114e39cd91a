import numpy as np
from pyspark.sql import functions as F

from segmill.llm import projection_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    root = {i: i for i, _, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = {i: 0 for i, _, _ in good}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, l), (j, y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                degree[i] += 1
                degree[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    for i, *_ in rows:
        c = find(i) if i in root else i
        out[i] = (degree.get(i, 0), c, c == i)
    return out


def test_small_windows_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(40):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 8)):
                rows.append((n, (base + rng.standard_normal(16) * 0.08).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(50)] + [(n + 60, rows[0][1], 1)]
    got = {r[0]: tuple(r[1:]) for r in projection_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), passes=12, window=16, span=2).collect()}
    want = brute(rows)
    assert sum(want[i] == got[i] for i in want) >= 0.95 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want) and sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_embeddings_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {r[0]: tuple(r[1:]) for r in projection_dedup.near_duplicates(df).collect()}
    assert got == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_dense_groups(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for label, (n, spread) in enumerate([(2000, 0.0125), (4000, 0.0004), (2500, 0.0185)]):
        # unit centre plus noise: mean cosines of about 0.99, 0.99999 and 0.979
        base = rng.standard_normal(64)
        x = (base / np.sqrt(base @ base) + rng.standard_normal((n, 64)) * spread).astype(np.float32)
        ids = np.arange(n) + len(rows)
        rows += [(int(i), v.tolist(), label) for i, v in zip(ids, x, strict=True)]
        u = x.astype(np.float64)
        u /= np.sqrt((u * u).sum(1))[:, None]
        want |= dict(zip(ids.tolist(), ((u @ u.T >= 0.98).sum(1) - 1).tolist(), strict=True))
    got = {r["vec_id"]: r["n_links"] for r in projection_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    share = [sum(got[i] for i, _, x in rows if x == label) / max(1, sum(want[i] for i, _, x in rows if x == label)) for label in (0, 1, 2)]
    assert all(got[i] <= want[i] for i in want) and share == [1.0, 1.0, 1.0]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 0.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0], 1), (12, [1.0, 0.0, 0.0], 1), (0, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("clash"), "copies": F.lit(1), "block": F.lit(2)})
    assert {r[0]: tuple(r[1:]) for r in projection_dedup.near_duplicates(df).collect()} == brute(rows)
    assert projection_dedup.near_duplicates(df.limit(0)).count() == 0


def by_row(rows, threshold=0.98):
    """brute() for rows that may share ids: a result for each row, in order."""
    own = brute([(k, v, x if i is not None else None) for k, (i, v, x) in enumerate(rows)], threshold)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        c = own[k][1]
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else None
    return [(i, own[k][0], least[own[k][1]], i is None or least[own[k][1]] == i) for k, (i, _, _) in enumerate(rows)]


def test_shared_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (6, [0.0, 0.0, 1.0], 1), (7, [0.0, 1.0, 0.001], 1), (8, [1.0, 0.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 2), (8, [0.0, 1.0, 0.002], 1), (None, [1.0, 0.0, 0.0], 1)]
    got = sorted(map(tuple, projection_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(by_row(rows), key=str) and len(got) == len(rows)


def test_sparse_pairs_just_above_the_threshold(spark):
    """Pairs with a cosine of 0.9805 to 0.985 among vectors of one label that link with nothing."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    side = rng.standard_normal((500, 64))
    side -= (side * x[:500]).sum(1)[:, None] * x[:500]
    side /= np.sqrt((side * side).sum(1))[:, None]
    cos = rng.uniform(0.9805, 0.985, 500)[:, None]
    x = np.concatenate([x, cos * x[:500] + np.sqrt(1 - cos * cos) * side]).astype(np.float32)
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in projection_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (0, i) for i in range(500, 4000))
    found = sum(got[i] == (1, i) and got[4000 + i] == (1, i) for i in range(500))
    assert found >= 495
