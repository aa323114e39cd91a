"""A hidden Markov language model over words.

A word is emitted in two steps: a latent state emits a class, the class emits the word. The `own` most frequent training words are
classes of their own; all others share `buckets` classes by their last three characters, and within a class a word has its
smoothed share, with half a count left for words never seen. So the tables that travel have a fixed size, and the vocabulary,
which grows with the corpus, stays in a table that is joined. The words that have no class of their own are the rarest; their
counts are learned in full, but the state tells only their class. Baum-Welch counts are summed over partitions by Spark, every
training token in every round, over whole documents. The score of a text is exact: a scaled forward recursion over all its
tokens, plus the words' shares.

Long sequences are taken in windows side by side: a window's transfer matrix (states before it by states at its end, the product
of its steps) gives the exact state distributions at all window edges, and from those each window is worked through alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: A word of more bytes than this is never a class of its own: bounds what is broadcast.
LONGEST = 256


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, counts = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy().astype(np.int64)
    full = pc.not_equal(words, "")  # leading and trailing white space leave empty words
    if pc.all(full).as_py() is False:
        owner = np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)]
        words, counts = words.filter(full), np.bincount(owner, minlength=len(counts))
    return words, counts


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): counts over all rows; each batch is counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=32 << 20):
                counts = pc.value_counts(_words(batch.column("text"))[0])
                yield pa.record_batch([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "c"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word[-3:].encode()) % buckets


def bucket_col(word: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.expr(f"right({word}, 3)").cast("binary")), F.lit(buckets)).cast("int")


#: Tokens of a window, and tokens worked through at once.
WINDOW, AT_ONCE = 256, 200_000


def _live(sizes: np.ndarray) -> list[int]:
    """Of sequences by falling size: how many have a token at each place."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))).tolist()


def _windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences laid end to end: first window and number of windows of each sequence; start and size of each window."""
    n = -(-sizes // window)
    first = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(first, n)
    return first, n, np.repeat(np.cumsum(sizes) - sizes, n) + step * window, np.minimum(window, np.repeat(sizes, n) - step * window)


def _transfer(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, opening: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's transfer matrix, scaled, and the natural log of its scale. An opening window's first step has no move before it."""
    k = len(move)
    out, logs = np.empty((len(at), k, k), emit.dtype), np.zeros(len(at))
    order = np.argsort(-sizes, kind="stable")
    per = max(1, AT_ONCE // WINDOW)
    for some in (order[i : i + per] for i in range(0, len(order), per)):
        begin, m = at[some], np.where(opening[some, None, None], np.eye(k, dtype=emit.dtype), move.astype(emit.dtype))
        for t, n in enumerate(_live(sizes[some])):
            x = (m[:n].reshape(-1, k) @ move).reshape(n, k, k) if t else m
            x = x * emit[flat[begin[:n] + t]][:, None, :]
            scale = x.max((1, 2))
            m[:n] = x / scale[:, None, None]
            logs[some[:n]] += np.log(scale)
        out[some] = m
    return out, logs


def _edges(first: np.ndarray, n: np.ndarray, transfer: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the windows' transfer matrices: the state distribution before each window, the weights of the states at its end by
    what follows (ones at the last), and each sequence's natural log of the scales of the distributions."""
    k = len(start)
    entry, leave, logs = np.zeros((len(transfer), k)), np.ones((len(transfer), k)), np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    alpha, live = np.tile(start, (len(n), 1)), _live(n[order])
    for step, many in enumerate(live):
        at = first[order[:many]] + step
        entry[at] = alpha[:many]
        alpha = np.einsum("nk,nkl->nl", alpha[:many], transfer[at])
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        logs[order[:many]] += np.log(scale)
    for step in range(len(live) - 1, 0, -1):
        at = first[order[: live[step]]] + step
        beta = np.einsum("nkl,nl->nk", transfer[at], leave[at])
        leave[at - 1] = beta / beta.sum(1, keepdims=True)
    return entry, leave, logs


def forward(ids: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Natural log likelihood of each sequence: scaled forward recursion, all sequences side by side, the longest first. Those of more than 8 windows go by transfer matrices."""
    sizes = np.array([len(x) for x in ids], np.int64)
    out, long = np.zeros(len(ids)), sizes > 8 * window
    for i in np.flatnonzero(long).tolist():
        first, n, at, size = _windows(sizes[i : i + 1], window)
        transfer, logs = _transfer(ids[i], at, size, np.arange(len(at)) == 0, move, emit)
        out[i] = logs.sum() + _edges(first, n, transfer, start)[2][0]
    short = np.flatnonzero(~long)
    order = short[np.argsort(-sizes[short], kind="stable")]
    while len(order):
        some = order[: max(1, int(np.searchsorted(np.cumsum(sizes[order]), 5 * AT_ONCE)))]
        order = order[len(some) :]
        flat, at = np.concatenate([ids[i] for i in some]), np.cumsum(sizes[some]) - sizes[some]
        alpha = np.tile(start, (len(some), 1))
        for t, n in enumerate(_live(sizes[some])):
            alpha = (alpha[:n] @ move if t else alpha[:n]) * emit[flat[at[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            out[some[:n]] += np.log(scale)
    return out


def expectations(docs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> None:
    """Add the expected counts of whole sequences: state by class, state to state, first state. counts has classes in rows."""
    docs = [d for d in docs if len(d)]
    if not docs:
        return
    flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    first, n, at, size = _windows(sizes, window)
    opening = np.zeros(len(at), bool)
    opening[first] = True
    entry, leave = np.tile(start, (len(at), 1)), np.ones((len(at), len(start)))
    many = n > 1
    if many.any():
        inner = np.repeat(many, n)
        transfer, _ = _transfer(flat, at[inner], size[inner], opening[inner], move, emit)
        entry[inner], leave[inner], _ = _edges(np.cumsum(n[many]) - n[many], n[many], transfer, start)
    order = np.argsort(-size, kind="stable")
    per = max(1, AT_ONCE // window)
    for some in (order[i : i + per] for i in range(0, len(order), per)):
        _expected(flat, at[some], size[some], opening[some], entry[some].astype(emit.dtype), leave[some].astype(emit.dtype), start, move, emit, counts, moves, starts)


def _expected(flat, at, sizes, opening, entry, leave, start, move, emit, counts, moves, starts) -> None:
    """expectations() of windows by falling size, given the distribution before each and the weights at its end."""
    live = _live(sizes)
    alphas, scales, emitted, ids = [], [], [], []
    alpha = np.where(opening[:, None], start.astype(emit.dtype), entry @ move)
    for t, n in enumerate(live):
        which = flat[at[:n] + t]
        e = emit[which]
        alpha = (alpha[:n] @ move if t else alpha) * e
        s = alpha.sum(1, keepdims=True)
        alpha /= s
        alphas.append(alpha)
        scales.append(s)
        emitted.append(e)
        ids.append(which)
    gammas, beta, m = [], leave[:0], 0
    for t in range(len(live) - 1, -1, -1):
        n, now = live[t], np.empty((live[t], len(start)), emit.dtype)
        if m:
            ahead = emitted[t + 1] * beta / scales[t + 1]
            moves += move * (alphas[t][:m].T @ ahead)
            now[:m] = ahead @ move.T
        now[m:] = leave[m:n] / (alphas[t][m:n] * leave[m:n]).sum(1, keepdims=True)
        gammas.append(alphas[t] * now)
        beta, m = now, n
    gammas.reverse()
    inner = ~opening
    moves += move * (entry[inner].T @ (emitted[0] * beta / scales[0])[inner])
    starts += gammas[0][opening].sum(0)
    ids, gammas = np.concatenate(ids), np.concatenate(gammas)
    for j in range(len(start)):
        counts[:, j] += np.bincount(ids, weights=gammas[:, j], minlength=len(counts))


def initial(unigram: np.ndarray, states: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sticky states whose emissions are the unigram shares, each state's perturbed in its own way."""
    emit = unigram[:, None] * np.exp(0.5 * np.random.default_rng(seed).standard_normal((len(unigram), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit / emit.sum(0)


def train(encoded: DataFrame, unigram: np.ndarray, states: int, rounds: int, kind: type, mass: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over encoded(ids); one Spark job a round, whose counts (classes by states) are summed by class before they come to the driver."""
    start, move, emit = initial(unigram, states)
    sc, classes = encoded.sparkSession.sparkContext, len(unigram)
    names = [f"s{j}" for j in range(states)]

    for _ in range(rounds):
        model = sc.broadcast((start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            counts, moves, starts = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
            held, size = [], 0
            for batch in batches:
                for raw in batch.column("ids"):
                    held.append(np.frombuffer(raw.as_buffer(), kind))
                    size += len(held[-1])
                    if size > 5 * AT_ONCE:
                        expectations(held, *model.value, counts, moves, starts)
                        held, size = [], 0
            expectations(held, *model.value, counts, moves, starts)
            rows = np.concatenate([counts, moves, starts[None]])
            used = np.flatnonzero(rows.any(1))
            yield pa.record_batch([pa.array(used.astype(np.int32)), *(pa.array(rows[used, j]) for j in range(states))], ["row", *names])

        summed = encoded.select("ids").mapInArrow(run, f"row int, {', '.join(f'{n} double' for n in names)}").groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        table = np.zeros((classes + states + 1, states))
        if summed.num_rows:
            table[summed["row"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], 1)
        counts, moves, starts = table[:classes], table[classes:-1], table[-1]
        emit = counts + mass * unigram[:, None]
        emit /= emit.sum(0)
        move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        start = (starts + 1) / (starts + 1).sum()
        model.unpersist()
    return start, move, emit


def score(docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 4, own: int = 49_152, buckets: int = 8_192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows where held_out is false.

    Tokens are lower-cased (A-Z) runs without ASCII white space and one end token a text. Null and empty texts are the end token
    alone. A null held_out counts as false. Repeated rows and null ids each give a row. Other columns are ignored. An empty table
    gives no rows; with no training rows every token is unknown and scores are those of the smoothing alone.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    learned = rows.where(~F.col("held"))
    vocab = written(vocabulary(learned), "vocabulary")
    n_docs = learned.count()
    words, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = words + n_docs, distinct + (n_docs > 0)
    divisor = tokens + 0.5 * (distinct + 1)
    top = vocab.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(own).toArrow()
    names, top_counts = top["word"].combine_chunks().cast(pa.string()), top["c"].to_numpy().astype(np.int64)
    m = len(names)
    least = (int(top_counts[-1]), names[-1].as_py()) if m == own else (0, "")
    is_own = (F.octet_length("word") <= LONGEST) & ((F.col("c") > least[0]) | ((F.col("c") == least[0]) & (F.col("word") <= least[1])))
    shared = vocab.where(~is_own).groupBy(bucket_col("word", buckets).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    in_bucket, distinct_in = np.zeros(buckets), np.zeros(buckets)
    in_bucket[shared["b"].to_numpy()], distinct_in[shared["b"].to_numpy()] = shared["c"].to_numpy(), shared["v"].to_numpy()
    # classes: 0 the end, then own words, then buckets
    unigram = np.concatenate([[n_docs], top_counts, in_bucket]) + 0.5
    class_kind = np.uint16 if len(unigram) <= 1 << 16 else np.uint32
    unigram /= unigram.sum()
    share = in_bucket + 0.5 * (distinct_in + 1)
    base_logs = np.log10((np.concatenate([[n_docs], top_counts]) + 0.5) / divisor)
    known = sc.broadcast((names, base_logs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, logs = known.value
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, most=16 << 20):
                words, counts = _words(batch.column("text"))
                coded = pc.dictionary_encode(words)
                which = coded.indices.to_numpy().astype(np.int64)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy().astype(np.int64)
                rare = np.flatnonzero(place < 0)
                code = place + 1
                code[rare] = [m + 1 + bucket(w, buckets) for w in coded.dictionary.take(pa.array(rare)).to_pylist()]
                owner = np.repeat(np.arange(len(batch)), counts)
                ids = np.zeros(len(which) + len(batch), class_kind)
                ends = np.cumsum(counts + 1)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = code[which]
                common = place[which] >= 0
                base = logs[0] + np.bincount(owner[common], logs[code[which[common]]], minlength=len(batch))
                n_known = np.bincount(owner[common], minlength=len(batch)) + int(n_docs > 0)
                pair, times = np.unique(owner[~common] * max(1, len(code)) + which[~common], return_counts=True)
                per_row = np.bincount(pair // max(1, len(code)), minlength=len(batch))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
                strings = coded.dictionary.take(pa.array(pair % max(1, len(code)))).cast(pa.string())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([strings, pa.array(times.astype(np.int32))], ["word", "times"]))
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), (counts + 1).tolist(), strict=True)]
                yield pa.record_batch([pa.array(np.arange(at, at + len(batch))), batch.column("id"), batch.column("held"), pa.array(counts + 1), pa.array(n_known), pa.array(base), pa.array(raw, pa.binary()), lists], ["row", "id", "held", "n_tokens", "n_known", "base", "ids", "rare"])
                at += len(batch)

    kind = rows.schema["id"].dataType.simpleString()
    encoded = written(rows.mapInArrow(encode, f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, ids binary, rare array<struct<word:string,times:int>>"), "encoded")
    model = train(encoded.where(~F.col("held")), unigram, states, rounds, class_kind)
    shared_model = sc.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                logs = forward([np.frombuffer(x.as_buffer(), class_kind) for x in batch.column("ids")], *shared_model.value) / np.log(10)
                yield pa.record_batch([*(batch.column(c) for c in ("row", "id", "held", "n_tokens", "n_known", "base")), pa.array(logs)], ["row", "id", "held", "n_tokens", "n_known", "base", "logs"])

    scored = encoded.select("row", "id", "held", "n_tokens", "n_known", "base", "ids").mapInArrow(likelihood, f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, logs double")
    shares = docs.sparkSession.createDataFrame([(b, float(s)) for b, s in enumerate(share)], "b int, share double")  # buckets rows
    each = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    seen = each.join(vocab.where(~is_own), "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).join(F.broadcast(shares), bucket_col("word", buckets) == F.col("b"))
    sums = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(float(divisor)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.col("share"))).alias("rare_logs"),
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", add("n_known", "rare_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), add("base", "rare_base").alias("base_score"), add("logs", "rare_logs").alias("score")
    )
