"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

A word's input is a hashed word vector beside the mean of its hashed character trigrams' vectors. Overlapping windows of a text
run through a GRU in either direction; attention pools the states of a window into one logit; a text's logit is its windows'
largest. Training is on a bounded sample of labelled rows on the driver (`sample` rows a class, of at most `sample_chars`
characters); each round picks every sampled text's windows with the largest logits and learns from those. Scoring runs over
every window of every text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices

WORD_BITS, GRAM_BITS, DIMS, HIDDEN = 15, 14, 8, 12
WINDOW, STRIDE = 32, 16
_EDGES = string.punctuation + "«»“”„’‘¿¡…–—"

Model = dict[str, np.ndarray]


#: Words hashed at once: bounds the memory of word inputs.
BLOCK = 20_000


def _inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"\x02" + (w.strip(_EDGES) or w).encode() + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join([*raw, b"\0\0"]), np.uint8).astype(np.uint64)
    grams = mixed((flat[:-2] << np.uint64(16)) | (flat[1:-1] << np.uint64(8)) | flat[2:])
    starts = np.cumsum(sizes) - sizes
    powers = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(flat) - 2, dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    whole = np.add.reduceat(mixed(flat[:-2] * powers + place), starts)
    inner = place < np.repeat(np.maximum(1, sizes - 2), sizes).astype(np.uint64)  # a trigram ends with its word
    return (mixed(whole) >> np.uint64(64 - WORD_BITS)).astype(np.int32), (grams[inner] >> np.uint64(64 - GRAM_BITS)).astype(np.int32), np.maximum(1, sizes - 2)


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: row of the word table; rows of the trigram table, all words' in one array; where each word's begin."""
    parts = [_inputs(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)]
    row, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))
    return row, grams, np.cumsum(counts) - counts


def word_vectors(m: Model, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The input vectors of word_inputs()."""
    row, grams, starts = words
    ends = np.append(starts[1:], len(grams))
    out = np.empty((len(row), 2 * DIMS), m["words"].dtype)
    out[:, :DIMS] = m["words"][row]
    for i in range(0, len(row), BLOCK):
        a, b = starts[i], ends[min(i + BLOCK, len(row)) - 1]
        out[i : i + BLOCK, DIMS:] = np.add.reduceat(m["grams"][grams[a:b]], starts[i : i + BLOCK] - a) / (ends - starts)[i : i + BLOCK, None]
    return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words, laid end to end: owner, first word and length of each window. The last one ends with its text."""
    n = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(step * STRIDE, np.maximum(0, counts[owner] - WINDOW))
    return owner, first + (np.cumsum(counts) - counts)[owner], np.minimum(WINDOW, counts[owner])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sums(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(n, k): values' rows summed by their place."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(at):
        out[sorted_at[starts]] = np.add.reduceat(values[order], starts)
    return out


def _gru(table: np.ndarray, at: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States (T, B, H) of inputs table[at[t]] (projected: update, reset, candidate)."""
    t_max, b = at.shape
    h = len(u)
    state, out = np.zeros((b, h), table.dtype), np.empty((t_max, b, h), table.dtype)
    for t in range(t_max):
        x, hu = table[at[t]], state @ u
        g = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
        z, r = g[:, :h], g[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
        new = n + z * (state - n)
        if mask is not None:
            new *= mask[t][:, None]
        if keep is not None:
            keep.append((state, z, r, n, hu[:, 2 * h :]))
        out[t] = state = new
    return out


def _gru_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of xs and u, given those of the states."""
    t_max, b, h = grad.shape
    dxs, du, carry = np.zeros((t_max, b, 3 * h), grad.dtype), np.zeros_like(u), np.zeros((b, h), grad.dtype)
    for t in range(t_max - 1, -1, -1):
        state, z, r, n, hn = kept[t]
        d = (grad[t] + carry) * mask[t][:, None]
        dn, dz, back = d * (1 - z) * (1 - n * n), d * (state - n) * z * (1 - z), d * z
        dr = dn * hn * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        dxs[t] = np.concatenate([dz, dr, dn], 1)
        du += state.T @ dhu
        carry = back + dhu @ u.T
    return dxs, du


def logits(m: Model, vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, most: int = 2048) -> np.ndarray:
    """One logit a window; ids (B, WINDOW) are rows of vectors, those past the length don't matter."""
    out = np.zeros(len(ids))
    for i in range(0, len(ids), most):
        # only the words of these windows are projected, so memory doesn't follow the vocabulary
        used, at = np.unique(ids[i : i + most], return_inverse=True)
        at, n = at.reshape(-1, WINDOW).T, lengths[i : i + most]
        ahead, behind = vectors[used] @ m["in_f"] + m["bias_f"], vectors[used] @ m["in_b"] + m["bias_b"]
        mask = None if (n == WINDOW).all() else (np.arange(WINDOW)[:, None] < n[None]).astype(vectors.dtype)
        states = np.concatenate([_gru(ahead, at, m["rec_f"], mask, None), _gru(behind, at[::-1], m["rec_b"], None if mask is None else mask[::-1], None)[::-1]], 2)
        a = states @ m["attend"]
        if mask is not None:
            a = np.where(mask > 0, a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        out[i : i + most] = ((states * a[:, :, None]).sum(0)) @ m["out"] + m["out_bias"]
    return out


def gradients(m: Model, words: tuple, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, Model]:
    """Mean logistic loss of windows and its gradients. words: word_inputs() of the rows that ids names."""
    row, grams, starts = words
    counts = np.diff(np.append(starts, len(grams)))
    used, at = np.unique(ids, return_inverse=True)
    at = at.reshape(ids.shape).T
    owner = np.repeat(np.arange(len(used)), counts[used])
    pick = np.repeat(starts[used] - (np.cumsum(counts[used]) - counts[used]), counts[used]) + np.arange(counts[used].sum())
    mean = _sums(len(used), owner, m["grams"][grams[pick]])
    vectors = np.concatenate([m["words"][row[used]], mean / counts[used][:, None]], 1)
    mask = (np.arange(WINDOW)[:, None] < lengths[None]).astype(vectors.dtype)
    kept_f, kept_b = [], []
    states = np.concatenate([_gru(vectors @ m["in_f"] + m["bias_f"], at, m["rec_f"], mask, kept_f), _gru(vectors @ m["in_b"] + m["bias_b"], at[::-1], m["rec_b"], mask[::-1], kept_b)[::-1]], 2)
    a = np.where(mask > 0, states @ m["attend"], -1e9)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = (states * a[:, :, None]).sum(0)
    x = pooled @ m["out"] + m["out_bias"]
    p = _sigmoid(x)
    loss = float(np.mean(np.logaddexp(0, x) - labels * x))
    dx = (p - labels) / len(labels)
    g = {"out": pooled.T @ dx, "out_bias": dx.sum(keepdims=True)}
    dpool = dx[:, None] * m["out"]
    along = (states * dpool[None]).sum(2)
    da = a * (along - (a * along).sum(0))
    g["attend"] = np.einsum("tb,tbh->h", da, states)
    dstates = a[:, :, None] * dpool[None] + da[:, :, None] * m["attend"]
    h = HIDDEN
    dvec = np.zeros_like(vectors)
    for side, d, kept, where, k in (("f", dstates[:, :, :h], kept_f, at, mask), ("b", dstates[::-1, :, h:], kept_b, at[::-1], mask[::-1])):
        dxs, g[f"rec_{side}"] = _gru_back(d, m[f"rec_{side}"], k, kept)
        total = _sums(len(used), where.ravel(), dxs.reshape(-1, 3 * h))
        g[f"bias_{side}"] = total.sum(0)
        g[f"in_{side}"] = vectors.T @ total
        dvec += total @ m[f"in_{side}"].T
    g["words"] = _sums(len(m["words"]), row[used], dvec[:, :DIMS])
    g["grams"] = _sums(len(m["grams"]), grams[pick], (dvec[:, DIMS:] / counts[used][:, None])[owner])
    return loss, g


def initial(rng: np.random.Generator, kind: type = np.float32) -> Model:
    d, h = 2 * DIMS, HIDDEN
    shapes = {"words": (1 << WORD_BITS, DIMS), "grams": (1 << GRAM_BITS, DIMS), "in_f": (d, 3 * h), "in_b": (d, 3 * h), "rec_f": (h, 3 * h), "rec_b": (h, 3 * h), "attend": (2 * h,), "out": (2 * h,)}
    m = {k: rng.standard_normal(s) * (0.1 if k in ("words", "grams") else s[0] ** -0.5) for k, s in shapes.items()}
    m |= {"bias_f": np.zeros(3 * h), "bias_b": np.zeros(3 * h), "out_bias": np.zeros(1)}
    return {k: v.astype(kind) for k, v in m.items()}


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, which word each token is, and how many tokens each text has."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    names, which, counts = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    if "" in names:
        owner, full = np.repeat(np.arange(len(counts)), counts), which != names.index("")
        which, counts = which[full], np.bincount(owner[full], minlength=len(counts))
    return names, which, counts


def _window_ids(which: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return which[np.minimum(first[:, None] + np.arange(WINDOW), (first + lengths - 1)[:, None])].astype(np.int32)


def fit(texts: list[str], labels: np.ndarray, share: float | None = None, rounds: int = 10, batch: int | None = None, seed: int = 3) -> dict:
    """Train on the given texts: model, and the slope and shift that turn a text's largest logit into a probability.

    share: of label 1 among all labelled rows; the sample is balanced, so the shift is moved to that share.
    """
    rng = np.random.default_rng(seed)
    balance = (float(labels.sum()) + 1) / (len(labels) + 2)
    prior = balance if share is None else share
    batch = batch or (128 if len(texts) > 2000 else 32)
    names, which, counts = _tokens(pa.array(texts, pa.string()))
    owner, first, lengths = windows(counts)
    if not len(owner) or labels.min() == labels.max():
        return {"prior": prior, "model": None}
    ids, words, m = _window_ids(which, first, lengths), word_inputs(names), initial(rng)
    # one input dimension starts as the log odds of the texts that hold the word, or the trigram
    row, grams, starts = words
    for table, rows, of in (("words", row, np.arange(len(names))), ("grams", grams, np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(grams)))))):
        pair = np.unique(np.repeat(np.arange(len(counts)), counts) * len(names) + which)
        text, word = pair // len(names), pair % len(names)
        texts_with = np.zeros((2, len(names)))
        np.add.at(texts_with, (labels[text].astype(int), word), 1)
        with_row = np.zeros((2, len(m[table])))
        for y in (0, 1):
            np.add.at(with_row[y], rows, texts_with[y][of])
        odds = np.log((with_row[1] + 1) / (labels.sum() + 2)) - np.log((with_row[0] + 1) / ((1 - labels).sum() + 2))
        m[table][:, 0] = np.clip(odds, -3, 3).astype(np.float32) * (with_row.sum(0) > 1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    order_of = np.cumsum(np.bincount(owner, minlength=len(counts))) - np.bincount(owner, minlength=len(counts))
    for k in range(rounds):
        # at first the window with the likeliest word
        x = m["words"][row, 0][ids].max(1) if k == 0 else logits(m, word_vectors(m, words), ids, lengths)
        best = np.lexsort((-x, owner))
        rank = np.arange(len(best)) - order_of[owner[best]]
        chosen = best[(rank == 0) | ((rank <= 2) & (labels[owner[best]] == 0))]
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            at = chosen[i : i + batch]
            _, g = gradients(m, words, ids[at], lengths[at], labels[owner[at]].astype(np.float32))
            step += 1
            for name, (a, b) in moments.items():
                a += 0.1 * (g[name] - a)
                b += 0.01 * (g[name] ** 2 - b)
                m[name] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(m[name].dtype)
    x = logits(m, word_vectors(m, words), ids, lengths)
    top = np.full(len(counts), -np.inf)
    np.maximum.at(top, owner, x)
    has = np.isfinite(top)
    x, y = top[has], labels[has].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # logistic calibration by Newton steps, held near the start
        p = _sigmoid(slope * x + shift)
        w = p * (1 - p) + 1e-4
        grad = np.array([((p - y) * x).mean() + 1e-3 * (slope - 1), (p - y).mean() + 1e-3 * shift])
        hess = np.array([[(w * x * x).mean() + 1e-3, (w * x).mean()], [(w * x).mean(), w.mean() + 1e-3]])
        change = np.linalg.solve(hess, grad)
        slope, shift = slope - change[0] * 0.5, shift - change[1] * 0.5
    return {"prior": prior, "model": m, "slope": max(slope, 1e-3), "shift": shift + np.log(prior / (1 - prior)) - np.log(balance / (1 - balance))}


def text_scores(fitted: dict, texts: pa.Array) -> np.ndarray:
    """The probability of each text, over all its windows; a text without words gets the share of label 1 in the training sample."""
    out = np.full(len(texts), fitted["prior"])
    if fitted["model"] is None:
        return out
    m = fitted["model"]
    names, which, counts = _tokens(texts)
    owner, first, lengths = windows(counts)
    vectors, top = word_vectors(m, word_inputs(names)), np.full(len(texts), -np.inf)
    full = lengths == WINDOW
    for at in (np.flatnonzero(full), np.flatnonzero(~full)):
        for i in range(0, len(at), 16_384):
            part = at[i : i + 16_384]
            np.maximum.at(top, owner[part], logits(m, vectors, _window_ids(which, first[part], lengths[part]), lengths[part]))
    has = counts > 0
    out[has] = _sigmoid(fitted["slope"] * top[has] + fitted["shift"])
    return out


def training_sample(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int, sample_chars: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, float]:
    """Texts, labels and the smoothed share of label 1 in all labelled rows that aren't held out. At most `sample` labelled rows a class that aren't held out, of at most sample_chars characters: those with the least hashes of the id."""
    fitting = docs.where(F.col(id_col).isNotNull() & ~F.coalesce(held_out, F.lit(False))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("mark"))
    every = fitting.select("id", (F.length("text") <= sample_chars).alias("short")).join(marks, "id").groupBy("id", "mark").agg(F.max("short").alias("short"))
    ids = every.where("short").select("id", "mark")
    ones, n = every.agg(F.coalesce(F.sum("mark"), F.lit(0)), F.count("*")).first()
    share = (ones + 1) / (n + 2)
    chosen = [r for y in (0, 1) for r in ids.where(F.col("mark") == y).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not chosen:
        return [], np.zeros(0), share
    few = docs.sparkSession.createDataFrame(chosen, ids.schema)  # 2 * sample rows at most
    rows = fitting.where(F.length("text") <= sample_chars).join(F.broadcast(few), "id").groupBy("id", "mark").agg(F.min("text").alias("text")).orderBy("id").select("text", "mark").toArrow()
    return rows["text"].to_pylist(), rows["mark"].to_numpy().astype(float), share


def score(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 1500, sample_chars: int = 12_000, rounds: int = 10, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: str | None = None) -> DataFrame:
    """docs' (id_col, held_out, score, predicted): score is the probability of label 1, predicted is 1 from 0.5 on.

    carry names a column to hand through. Only texts are inputs; labels of rows that held_out marks are never read. Null, empty and blank texts get the share of label
    1 among the training rows. Null ids, repeated rows and unlabelled rows are scored like any other; conflicting labels of an id
    count as 1. Without training rows of both labels every score is the smoothed share. Other columns are ignored; an empty
    table gives no rows.
    """
    texts, marks, share = training_sample(docs, labels, held_out, sample, sample_chars, id_col, text_col, label_col)
    fitted = docs.sparkSession.sparkContext.broadcast(fit(texts, marks, share, rounds) if texts else {"prior": share, "model": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                x = text_scores(fitted.value, batch.column("text"))
                yield pa.record_batch([batch.column("id"), batch.column("held"), pa.array(x), pa.array((x >= 0.5).astype(np.int32)), *(batch.column(c) for c in extra)], ["id", "held_out", "score", "predicted", *extra])

    extra = [carry] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"), *extra)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int{kinds}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that score() predicts as 1; all its columns."""
    mark = score(docs.withColumn("_row", F.struct("*")), labels, held_out, id_col=id_col, text_col=text_col, carry="_row", **options)
    return mark.where("predicted = 0").select("_row.*")
