import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from segmill.llm import toxicity

def HELD():  # noqa: N802
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0



def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    owner, first, lengths = toxicity.windows(counts)
    at = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = {x for f, l in zip(first[owner == k] - at[k], lengths[owner == k]) for x in range(f, f + l)}
        assert seen == set(range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    m = toxicity.initial(rng, np.float64)
    names = [f"word{i}" for i in range(20)]
    words = toxicity.word_inputs(names)
    ids, lengths, labels = rng.integers(0, 20, (5, toxicity.WINDOW)), np.array([32, 3, 1, 32, 20]), np.array([1.0, 0, 1, 0, 1])
    loss, g = toxicity.gradients(m, words, ids, lengths, labels)
    x = toxicity.logits(m, toxicity.word_vectors(m, words), ids, lengths)
    assert np.isclose(loss, np.mean(np.logaddexp(0, x) - labels * x))
    for name, v in m.items():
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-6)
        for k in rng.choice(flat, min(4, len(flat)), replace=False):
            kept, ends = v.ravel()[k], []
            for d in (1e-5, -1e-5):
                v.ravel()[k] = kept + d
                ends.append(toxicity.gradients(m, words, ids, lengths, labels)[0])
            v.ravel()[k] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-5, g[name].ravel()[k], rtol=1e-3, atol=1e-7), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, labels, HELD())
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 1].predicted.mean() > 0.8
    assert ((held.score >= 0) & (held.score <= 1)).all()


def test_a_late_window_counts(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas(), spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = docs.merge(labels, on="doc_id")
    fitted = toxicity.fit(both.text.tolist(), both.toxic.to_numpy().astype(float))
    clean = both[both.toxic == 0].text.iloc[:40].str.cat(sep=" ")
    a, b = toxicity.text_scores(fitted, pa.array([clean, clean + " you stupid worthless idiot, pathetic scum"]))
    assert b > 0.5 and b > a


def test_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, 0), (12, 1), (99, 1), (None, 1), (6, 7)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(edge, labels, HELD(), rounds=2).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    none = toxicity.score(edge, labels.limit(0), HELD()).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score(edge.limit(0), labels, HELD()).count() == 0


def test_scores_equal_a_plain_computation():
    """Word by word, window by window, with the equations written out."""
    rng = np.random.default_rng(6)
    m = toxicity.initial(rng, np.float64)
    for k in ("bias_f", "bias_b", "out_bias"):
        m[k] += rng.standard_normal(m[k].shape)
    fitted = {"model": m, "slope": 1.3, "shift": -0.4, "prior": 0.07}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def states(vectors, side):
        state, out = np.zeros(h), []
        for v in vectors:
            x, u = v @ m[f"in_{side}"] + m[f"bias_{side}"], state @ m[f"rec_{side}"]
            z, r = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * state
            out.append(state)
        return out

    def logit(words):
        vectors = []
        for w in words:
            row, grams, _ = toxicity.word_inputs([w])
            vectors.append(np.concatenate([m["words"][row[0]], m["grams"][grams].mean(0)]))
        both = [np.concatenate(x) for x in zip(states(vectors, "f"), states(vectors[::-1], "b")[::-1], strict=True)]
        weights = np.exp([s @ m["attend"] for s in both])
        return float(sum(w * s for w, s in zip(weights / weights.sum(), both, strict=True)) @ m["out"] + m["out_bias"][0])

    texts = [None, "", " \n"] + [" ".join(f"Wort{rng.integers(0, 60)}," for _ in range(n)) for n in (1, 2, 16, 31, 32, 33, 48, 49, 100)]
    got = toxicity.text_scores(fitted, pa.array(texts, pa.string()))
    for text, x in zip(texts, got, strict=True):
        words = (text or "").lower().split()
        n, size, step = len(words), toxicity.WINDOW, toxicity.STRIDE
        starts = [0] if n <= size else [*range(0, n - size, step), n - size]
        want = sigmoid(1.3 * max(logit(words[i : i + size]) for i in starts) - 0.4) if words else 0.07
        assert abs(x - want) < 1e-9


def test_short_runs_lie_whole_in_a_window():
    """Every run of WINDOW - STRIDE + 1 words is in one window."""
    run = toxicity.WINDOW - toxicity.STRIDE + 1
    for n in (17, 32, 33, 47, 48, 49, 200):
        _, first, lengths = toxicity.windows(np.array([n]))
        assert all(any(a <= i and i + run <= a + k for a, k in zip(first, lengths, strict=True)) for i in range(n - run + 1))
