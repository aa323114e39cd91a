"""Exact repeated-substring removal by a distributed merge sort of suffixes that never compares a known prefix twice.

Sorted suffixes tell repeats by the common prefix with their neighbours. Most suffixes can't matter, and are left out first,
by filters that lose nothing:

1. Anchors. Every 200-byte window has an anchor: its 100-byte gram with the least hash, the first of equal ones. Equal windows
   have equal anchors at equal places. A run of windows with one anchor is a context. Contexts whose gram occurs once hold
   no repeat.
2. Contexts that are equal byte for byte are one context with a weight. They are told apart by 128 bits: 64 of their anchor gram
   and 64 of all their bytes; contexts with the same gram by the latter alone.
3. Heads. In the contexts that remain, a window needs its own suffix only if it opens a context, or the windows equal to it
   have different bytes before them (or none): a repeat that can be extended to the left is found from its start.

The suffixes at heads (each up to the next head of its context, plus a window) are sorted: splitters from a sample set ranges; each task sorts
its suffixes and sends every range a front-coded run (common prefix with the one before, then the rest); a range merges its
runs with a loser tree whose entries carry the length of the prefix they share with the last winner, so that comparisons begin
behind it. Runs of equal suffixes are merged beforehand into one with a weight, so no range has more than its share.
A suffix that shares at least 200 bytes with a neighbour, or has a weight of two, marks windows as repeated; bytes that such
windows cover are removed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Rolling, bloom, in_bloom, mixed, slices, written

SPAN, GRAM = 200, 100
#: Bytes hashed at once: bounds a task's memory, whatever the length of a text. Places in a buffer have to fit 24 bits.
PIECE = 1 << 19


def anchors(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """The contexts of texts: g (gram hash), c (hash of all its bytes, the byte before and its shape), text (index), lo (first
    window), n (windows), left (byte before the first window; -1: none). Long texts are taken in pieces; a piece's first window counts as having none."""
    found, held, size = [], [], 0
    for i, t in enumerate(texts):
        for p in range(0, max(0, len(t) - span + 1), PIECE):
            held.append((t[p : min(len(t), p + PIECE + span - 1)], i, p))
            size += len(held[-1][0])
            if size >= PIECE:
                found.append(_anchors(held, span, gram))
                held, size = [], 0
    if held:
        found.append(_anchors(held, span, gram))
    return {c: np.concatenate([x[c] for x in found]) for c in found[0]} if found else None


def _anchors(pieces: list[tuple[bytes, int, int]], span: int, gram: int) -> dict[str, np.ndarray]:
    """The contexts of pieces: bytes (a window at least), index of the text and place in it."""
    raw, owner, base = zip(*pieces, strict=True)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, w = np.cumsum(sizes) - sizes, span - gram + 1
    roll = Rolling(buf)
    g = roll.all(gram)
    # hash above, place below: the least is the first of the least hashes
    v = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    m = len(v)
    rows = np.concatenate([v, np.full(-m % w + w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    before, after = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(after[: m - w + 1], before[w - 1 : m]) & np.uint64(0xFFFFFF)).astype(np.int64)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[starts + sizes - span + 1] -= 1  # pieces have a window at least, so the two differ
    anchor[np.cumsum(edge[: len(anchor)], dtype=np.int8) == 0] = -1
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(lo, len(anchor)))
    used = anchor[lo] >= 0
    lo, n = lo[used], n[used]
    a, piece = anchor[lo], np.searchsorted(starts, lo, side="right") - 1
    left = np.where(lo == starts[piece], -1, buf[np.maximum(lo - 1, 0)].astype(np.int64))
    shape = ((a - lo) << 40) | (n << 20) | (left + 1)
    return {"g": g[a], "c": mixed(roll(lo, lo + n - 1 + span) ^ mixed(shape.astype(np.uint64))), "text": np.array(owner)[piece], "lo": lo - starts[piece] + np.array(base)[piece], "n": n, "left": left}


def common_prefix(a: bytes, b: bytes, i: int) -> int:
    """Length of the common prefix of a and b, which agree on the first i bytes."""
    n = min(len(a), len(b))
    step = 64
    while i < n:
        if a[i : i + step] == b[i : i + step]:
            i = min(n, i + step)
        elif step == 1:
            break
        else:
            step >>= 2
    return i


def front_coded(run: list[tuple[bytes, int]]) -> bytes:
    """A sorted run of (suffix, weight) as bytes: for each the prefix shared with the one before, the size of the rest, the weight and the rest."""
    head, rest, last = np.zeros((len(run), 3), np.int64), [], b""
    for k, (s, weight) in enumerate(run):
        i = common_prefix(last, s, 0)
        head[k] = i, len(s) - i, weight
        rest.append(s[i:])
        last = s
    return len(run).to_bytes(8, "little") + head.tobytes() + b"".join(rest)


def unpacked(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(suffix, prefix shared with the one before, weight), one after the other."""
    n = int.from_bytes(raw[:8], "little")
    at, last = 8 + 24 * n, b""
    for i, size, weight in np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        last = last[:i] + raw[at : at + size]
        at += size
        yield last, i, weight


def merged(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge sorted runs by a loser tree: (suffix, prefix shared with the suffix before, weight).

    Every entry's prefix length is relative to the last winner: the one with the longer is the smaller, and only equal ones are
    compared, from there on (the last winner's successor has it from its own run's front coding).
    """
    k = len(runs)
    heads: list[tuple[bytes, int] | None] = []
    shared = [0] * k  # of each run's head with the last winner
    for r in runs:
        x = next(r, None)
        heads.append(None if x is None else (x[0], x[2]))

    def smaller(i: int, j: int) -> int:
        """The winner of runs i and j; the loser's shared prefix becomes that with the winner."""
        if heads[i] is None or heads[j] is None:
            return i if heads[j] is None else j
        if shared[i] != shared[j]:
            return i if shared[i] > shared[j] else j
        a, b = heads[i][0], heads[j][0]
        n = common_prefix(a, b, shared[i])
        first = n == len(a) or (n < len(b) and a[n] < b[n])
        shared[j if first else i] = n
        return i if first else j

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size
    winners = [*[-1] * size, *range(k), *[-1] * (size - k)]
    for node in range(size - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        w = i if j < 0 else j if i < 0 else smaller(i, j)
        winners[node], losers[node] = w, (j if w == i else i)
    top = winners[1]
    while top >= 0 and heads[top] is not None:
        s, weight = heads[top]
        yield s, shared[top], weight
        x = next(runs[top], None)
        heads[top], shared[top] = (None, 0) if x is None else ((x[0], x[2]), x[1])
        node = (top + size) // 2
        while node:
            other = losers[node]
            if other >= 0:
                w = smaller(top, other)
                losers[node] = other if w == top else top
                top = w
            node //= 2


def sort_suffixes(suffixes: DataFrame, ranges: int) -> DataFrame:
    """suffixes(suffix binary, weight long), distinct -> (suffix, weight, shared int): the longest common prefix with a neighbour of the sorted order."""
    # 16 prefixes a range are sampled for the splitters; any string splits
    n = suffixes.count()
    sample = sorted(bytes(r[0]) for r in suffixes.select(F.substring("suffix", 1, SPAN + 56)).sample(fraction=min(1.0, 16 * ranges / max(1, n)), seed=1).limit(32 * ranges).collect()) if ranges > 1 else []
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            held.sort()
            parts: dict[int, list] = {}
            for x in held:
                parts.setdefault(bisect_right(splitters, x[0]), []).append(x)
            out = pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([front_coded(x) for x in parts.values()], pa.binary())], ["range", "run"])
            held.clear()
            return out

        for batch in batches:
            for x in zip(batch.column("suffix").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                held.append(x)
                size += len(x[0])
                if size > 16 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [r for b in batches for r in b.column("run").to_pylist()]
        names, weights, shared = [], [], []
        for s, i, weight in merged([unpacked(r) for r in coded]):
            if names:
                shared[-1] = max(shared[-1], i)
            names.append(s)
            weights.append(weight)
            shared.append(i if len(names) > 1 else 0)
        edge = np.zeros(len(names), bool)
        edge[[0, -1]] = True
        for k in range(0, len(names), 20_000):
            part = slice(k, k + 20_000)
            yield pa.record_batch([pa.array([key[0].as_py()] * len(names[part]), pa.int32()), pa.array(names[part], pa.binary()), pa.array(weights[part], pa.int64()), pa.array(shared[part], pa.int32()), pa.array(edge[part]), pa.array(np.arange(len(names))[part] == 0)], ["range", "suffix", "weight", "shared", "edge", "first"])

    coded = suffixes.select("suffix", "weight").mapInArrow(runs, "range int, run binary")
    ordered = written(coded.groupBy("range").applyInArrow(merge, "range int, suffix binary, weight long, shared int, edge boolean, first boolean"), "sorted")
    # neighbours across ranges: two rows of each range
    along = Window.orderBy("range", F.desc("first"), "suffix")
    edges = ordered.where("edge").select("range", "suffix", "weight", "shared", "first", F.lag("suffix").over(along).alias("before"), F.lead("suffix").over(along).alias("after"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("suffix", "shared", "before", "after")), strict=True)
            best = [max(n, *(common_prefix(s, o, 0) if o is not None else 0 for o in (p, q))) for s, n, p, q in rows]
            yield pa.record_batch([b.column("suffix"), b.column("weight"), pa.array(best, pa.int32())], ["suffix", "weight", "shared"])

    joined = edges.mapInArrow(across, "suffix binary, weight long, shared int")
    return ordered.where(~F.col("edge")).select("suffix", "weight", "shared").unionByName(joined)


def _digests(column: str) -> list:
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(1), column).alias("k2")]


#: Keys up to which a broadcast filter of 32 MB spares shuffles (four bits a key and more); more are joined.
FILTER_KEYS = 1 << 26


def repeated(texts: DataFrame, span: int = SPAN, gram: int = GRAM, range_rows: int = 50_000, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """texts(raw binary) -> (k1, k2, cuts array<struct<start, end>>): the repeated byte ranges of each distinct text that has any; k1 and k2 are its digests.

    Each of the three sets of keys that decide what travels (repeated grams, contexts to fetch, opening windows) is broadcast as a filter
    if it has at most filter_keys keys. A larger one is joined: contexts with grams by the gram, texts with the places wanted of
    them by their digests, windows with openings by their hash. What comes out is the same.
    """
    keyed = texts.where(F.octet_length("raw") >= span).select("raw", *_digests("raw"))

    def scan(emit, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "raw", PIECE):
                    raw = batch.column("raw").to_pylist()
                    found = anchors(raw, span, gram)
                    if found is not None and (out := emit(found, raw, batch)) is not None:
                        yield pa.record_batch(out, names)

        return keyed.mapInArrow(run, schema)

    def grams(found, raw, batch):
        g, n = np.unique(found["g"], return_counts=True)
        return [pa.array(g.view(np.int64)), pa.array(n)]

    counts = scan(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    sc = texts.sparkSession.sparkContext

    def filter_of(keys: DataFrame, key: str):
        return sc.broadcast(bloom(keys, key)) if keys.count() <= filter_keys else None

    repeated_grams = written(counts.where("n > 1").select("g"), "repeated-grams")
    often = filter_of(repeated_grams, "g")

    def keep(found, raw, batch, at):
        k1, k2 = (batch.column(c).to_numpy()[found["text"][at]] for c in ("k1", "k2"))
        return [*(pa.array(found[c][at].view(np.int64)) for c in ("g", "c")), pa.array(k1), pa.array(k2), pa.array(found["lo"][at].astype(np.int64))]

    def members_of(found, raw, batch):
        at = np.arange(len(found["g"])) if often is None else np.flatnonzero(in_bloom(often.value, found["g"]))
        return [*keep(found, raw, batch, at), pa.array(found["n"][at].astype(np.int32))] if len(at) else None

    members = scan(members_of, "g long, c long, k1 long, k2 long, lo long, n int")
    members = written(members if often else members.join(repeated_grams, "g", "left_semi"), "members")
    contexts = written(members.groupBy("g", "c").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "lo")).alias("at"), F.max("n").alias("n")), "contexts")
    groups = written(contexts.groupBy("g").agg(F.count("*").alias("kinds")), "groups")
    varied = written(contexts.join(groups.where("kinds > 1").select("g"), "g").select("g", "c", "weight", "n", "at.*"), "varied")
    wanted = filter_of(varied.select(F.col("k1").bitwiseXOR(F.col("c")).bitwiseXOR(F.shiftleft("lo", 33)).alias("p")), "p") if often else None

    def bytes_of(found, raw, batch):
        k1 = batch.column("k1").to_numpy()[found["text"]]
        at = np.flatnonzero(in_bloom(often.value, found["g"]) & in_bloom(wanted.value, k1 ^ found["c"].view(np.int64) ^ (found["lo"].astype(np.int64) << 33)))
        if not len(at):
            return None
        cut = [raw[t][lo : lo + n - 1 + span] for t, lo, n in zip(*(found[c][at].tolist() for c in ("text", "lo", "n")), strict=True)]
        return [*keep(found, raw, batch, at), pa.array(found["left"][at].astype(np.int32)), pa.array(cut, pa.binary())]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the places wanted of each text; the window at the start of a piece has no byte before it, as in anchors()."""
        for whole in batches:
            for batch in slices(whole, "raw", PIECE):
                texts, places = batch.column("raw").to_pylist(), batch.column("places").to_pylist()
                rows = [(p, t) for t, ps in zip(texts, places, strict=True) for p in ps]
                columns = [pa.array([p[c] for p, _ in rows], pa.int64()) for c in ("g", "c", "weight")]
                left = [-1 if p["lo"] % PIECE == 0 else t[p["lo"] - 1] for p, t in rows]
                cut = [t[p["lo"] : p["lo"] + p["n"] - 1 + span] for p, t in rows]
                yield pa.record_batch([*columns, pa.array(left, pa.int32()), pa.array(cut, pa.binary())], ["g", "c", "weight", "left", "raw"])

    if wanted:
        fetched = varied.join(scan(bytes_of, "g long, c long, k1 long, k2 long, lo long, left int, raw binary"), ["g", "c", "k1", "k2", "lo"])
    else:
        places = varied.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "c", "weight", "n", "lo")).alias("places"))  # fewer than a text has bytes
        fetched = keyed.join(places, ["k1", "k2"]).select("raw", "places").mapInArrow(asked, "g long, c long, weight long, left int, raw binary")
    strings = written(fetched.groupBy("g", "c", "weight").agg(F.min(F.struct("left", "raw")).alias("s")).select("g", "c", "weight", "s.left", "s.raw"), "context-bytes")

    def hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, owner and offset of all windows."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n, starts = sizes - span + 1, np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(raw)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = starts[owner] + off
        return Rolling(np.frombuffer(b"".join(raw), np.uint8))(p, p + span), owner, off

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "raw", PIECE):
                raw = batch.column("raw").to_pylist()
                h, owner, off = hashes(raw)
                flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw[:-1])])
                left = np.where(off > 0, flat[np.maximum(starts[owner] + off - 1, 0)].astype(np.int32), batch.column("left").to_numpy()[owner])
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(left.astype(np.int16))], ["h", "left"])

    seen = strings.mapInArrow(windows, "h long, left short").groupBy("h").agg(F.count("*").alias("n"), F.min("left").alias("a"), F.max("left").alias("b"))
    openings = written(seen.where("n > 1 and (a <> b or a < 0)").select("h"), "openings")
    opening = filter_of(openings, "h")

    def window_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "raw", PIECE):
                h, owner, off = hashes(batch.column("raw").to_pylist())
                rows = batch.take(pa.array(owner))
                yield pa.record_batch([rows.column("g"), rows.column("c"), pa.array(off.astype(np.int32)), pa.array(h.view(np.int64))], ["g", "c", "off", "h"])

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "raw", PIECE):
                raw = batch.column("raw").to_pylist()
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                if opening:
                    h, owner, off = hashes(raw)
                    at = np.flatnonzero((off == 0) | in_bloom(opening.value, h))
                    o, f = owner[at], off[at]
                else:
                    offs = [sorted({0, *(x or [])}) for x in batch.column("offs").to_pylist()]
                    o, f = np.repeat(np.arange(len(raw)), [len(x) for x in offs]), np.array([y for x in offs for y in x], np.int64)
                end = np.append(f[1:], 0)
                last = np.append(o[1:] != o[:-1], True)
                end = np.where(last, sizes[o], end - 1 + span)
                cut = [raw[i][a:b] for i, a, b in zip(o.tolist(), f.tolist(), end.tolist(), strict=True)]
                rows = batch.take(pa.array(o))
                yield pa.record_batch([rows.column("g"), rows.column("c"), rows.column("weight"), pa.array(f.astype(np.int32)), pa.array(cut, pa.binary())], ["g", "c", "weight", "off", "suffix"])

    if not opening:
        offs = strings.mapInArrow(window_places, "g long, c long, off int, h long").join(openings, "h", "left_semi").groupBy("g", "c").agg(F.collect_list("off").alias("offs"))
        strings = strings.join(offs, ["g", "c"], "left")
    heads = written(strings.mapInArrow(heads_of, "g long, c long, weight long, off int, suffix binary"), "heads")
    distinct = written(heads.groupBy("suffix").agg(F.sum("weight").alias("weight")), "suffixes")
    ranges = max(1, -(-distinct.count() // range_rows))
    ordered = sort_suffixes(distinct, ranges)
    # windows that are repeated from the head on
    length = F.when(F.col("weight") > 1, F.octet_length("suffix")).otherwise(F.col("shared")) - (span - 1)
    verdicts = written(ordered.select(F.xxhash64("suffix").alias("x1"), F.xxhash64(F.lit(1), "suffix").alias("x2"), length.cast("int").alias("run")).where("run > 0"), "verdicts")
    marked = heads.select("g", "c", "off", F.xxhash64("suffix").alias("x1"), F.xxhash64(F.lit(1), "suffix").alias("x2")).join(verdicts, ["x1", "x2"]).groupBy("g", "c").agg(F.collect_list(F.struct("off", "run")).alias("runs"))
    # a context that occurs twice is repeated whole
    whole = contexts.where("weight > 1").select("g", "c", F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("run"))).alias("runs"))
    found = marked.join(whole.select("g", "c"), ["g", "c"], "left_anti").unionByName(whole)
    found = written(found, "repeats")
    cuts = members.join(found, ["g", "c"]).select("k1", "k2", "lo", F.explode("runs").alias("r")).select("k1", "k2", F.struct((F.col("lo") + F.col("r.off")).alias("start"), (F.col("lo") + F.col("r.off") + F.col("r.run") - 1 + span).alias("end")).alias("cut"))
    return written(cuts.groupBy("k1", "k2").agg(F.collect_set("cut").alias("cuts")), "cuts")


def without(raw: bytes, cuts: list[tuple[int, int]], whole_characters: bool = False) -> tuple[bytes, int]:
    """What is left of raw without the union of cuts, and how many runs that takes out. whole_characters: UTF-8 characters that a cut splits go whole."""
    kept, at, spans, open_end = [], 0, 0, -1
    for start, end in sorted(cuts):
        while whole_characters and start > 0 and raw[start] & 0xC0 == 0x80:
            start -= 1
        while whole_characters and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        if start > open_end:
            kept.append(raw[at:start])
            spans += 1
        open_end = at = max(open_end, end)
    kept.append(raw[at:])
    return b"".join(kept), spans


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", carry: list[str] | None = None, whole_characters: bool = False, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """docs' columns in carry and (kept binary, n_bytes, n_removed, n_spans): each text without the bytes that a string of `span` bytes covers which starts elsewhere too.

    Strings are those of the input, of any document, this one included, and may overlap. Null texts count as empty. Texts of
    fewer than span bytes stay whole. Repeated rows are occurrences of their own, so rows with an equal text of at least span bytes
    lose all of it. Null ids change nothing; columns not in carry are ignored, columns in carry may have any names but those of
    the four results; an empty table gives no rows. kept may begin or end inside a character, unless whole_characters also
    removes the rest of characters that lose a byte.
    """
    carry = ["doc_id"] if carry is None else carry
    if clash := set(carry) & {"kept", "n_bytes", "n_removed", "n_spans"}:
        raise ValueError(f"columns named like results can't be carried: {sorted(clash)}")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    cuts = repeated(rows.select("raw"), span, gram, filter_keys=filter_keys)
    both = rows.select("*", *_digests("raw")).join(cuts, ["k1", "k2"], "left").select("row", "raw", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "raw"):
                raw = b.column("raw").to_pylist()
                out = [without(r, [(c["start"], c["end"]) for c in x or []], whole_characters) for r, x in zip(raw, b.column("cuts").to_pylist(), strict=True)]
                sizes, kept = [len(r) for r in raw], [k for k, _ in out]
                yield pa.record_batch([b.column("row"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()), pa.array([s for _, s in out], pa.int64())], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = StructType([rows.schema["row"], StructField("kept", BinaryType()), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    return both.mapInArrow(cut, schema).select("row.*", "kept", "n_bytes", "n_removed", "n_spans")
