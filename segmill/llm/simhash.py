"""SimHash near-duplicates by covering locality-sensitive hashing.

A pair of fingerprints that differs in at most `radius` bits is certain to agree under one of the masks: bit i gets a nonzero
vector m(i) of radius + 1 bits, and mask v keeps the bits with an odd inner product of v and m(i). Up to `radius` vectors
never span the whole space, so some v is orthogonal to all of them and its mask drops every differing bit (Pagh, 2016).

near_duplicates() links fingerprints. keep_one() links texts of which at least 0.8 of the five-word shingles are common. Such texts
differ in up to 16 of 64 bits, and covering that radius takes 131,071 masks; so the masks of a small radius are one source
of candidates there, bands of minimum hashes of the same shingles are the other, and every link is verified on the shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Rolling, bloom, components, mixed, passing, slices, written

SEED = 42
WHITE = re.compile(rb"[\x20\x09-\x0d]")


@cache
def masks(radius: int = 2, bits: int = 64) -> tuple[int, ...]:
    """The 2**(radius+1) - 1 covering masks, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    return tuple(sum(1 << i for i in range(bits) if (v & (i % n + 1)).bit_count() & 1) for v in range(1, n + 1))


def word_runs(text: bytes, width: int, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-case words of text, in runs of about `most` bytes that overlap by width - 1 words: each sequence of width words is in one run.

    Bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D. A text of fewer words is one run, one without words none.
    """
    held: list[bytes] = []
    at, first = 0, True
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (gap := WHITE.search(text, end)):
            end = gap.start()
        elif end < len(text):
            end = len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= width or (at == len(text) and first and held):
            yield held
            first, held = False, held[len(held) - width + 1 :] if width > 1 else []


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = (ends - np.diff(ends, prepend=0)).tolist(), (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[min(width, len(words)) - 1 :], strict=True)), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each of the 64 bits."""
    count = np.zeros(64, np.int64)
    for part in (h[i : i + 65536] for i in range(0, len(h), 65536)):
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return count


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits; a bit is set if more than half the shingle hashes have it. No words: 0."""
    count, n = np.zeros(64, np.int64), 0
    for words in word_runs(text, width):
        h = _shingle_hashes(words, width)
        count, n = count + bit_counts(h), n + len(h)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long). Null texts count as empty; an empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = np.fromiter((fingerprint((t or "").encode(), width) for t in batch.column("text").to_pylist()), np.uint64, len(batch))
                yield pa.record_batch([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes(fp), distinct -> (a, b): every pair that differs in at most radius bits, once, a < b."""
    kept = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    keys = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "key"))
    a, b = keys.alias("a"), keys.alias("b")
    differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # a pair may agree under several masks; it counts under the first
    first = F.coalesce(*(F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(signed)))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differing) <= radius) & (first == F.col("a.t"))
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id): component_id is the smallest id that links of at most radius differing bits reach.

    Equal fingerprints are one node. Empty, null and white-space texts have fingerprint 0 and link like any other. Rows with a
    null id keep their row; they take no part in the smallest id, and are null if their component has no other. Repeated rows
    each give a row. Other columns of docs are ignored; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = components(nodes.select("fp"), links(nodes.select("fp"), radius), "fp")
    labelled = nodes.join(found, "fp")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(labelled.join(least, "component").select("fp", "component_id"), "components")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Members of a candidate bucket that are compared in one piece, and their bytes.
BLOCK, BLOCK_BYTES = 128, 8 << 20
_FACTORS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the sequences of width words, repeats included, run by run."""
    for words in word_runs(text, width):
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        n, k = max(1, len(words) - width + 1), min(width, len(words))
        starts = (ends - np.diff(ends, prepend=0))[:n]
        yield Rolling(np.frombuffer(b" ".join(words), np.uint8))(starts, ends[k - 1 :] - 1)


def candidate_keys(text: bytes, width: int, radius: int, bands: int, rows: int) -> list[int]:
    """A key for each covering mask of the fingerprint, then one for each band of `rows` minimum hashes; none without words."""
    count, n, least = np.zeros(64, np.int64), 0, np.full(bands * rows, 2**64 - 1, np.uint64)
    for h in shingles(text, width):
        count, n = count + bit_counts(h), n + len(h)
        for part in (h[i : i + 8192] for i in range(0, len(h), 8192)):
            least = np.minimum(least, (part[:, None] * _FACTORS[None, : bands * rows]).min(0))
    if not n:
        return []
    fp = np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0]
    band = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        band = mixed(band ^ column) + np.uint64(1)
    return np.concatenate([fp & np.array(masks(radius), np.uint64), band]).view(np.int64).tolist()


def _linked(sets: list[np.ndarray], group: list[int], against: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links that join different groups: of every two sets with a Jaccard similarity of at least `similarity`, one of them being in `against`, the groups are equal or joined."""
    root = {g: g for g in group}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in range(len(sets)):
        for j in range(i):
            if not (against[i] or against[j]):
                continue
            a, b = find(group[i]), find(group[j])
            n, m = len(sets[i]), len(sets[j])
            if a == b or min(n, m) < similarity * max(n, m):
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if common >= similarity * (n + m - common):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _verified(members: DataFrame, texts: DataFrame, width: int, similarity: float, parts: int) -> DataFrame:
    """members(unit, node, component, against) and texts(node, text) -> (a, b): verified links between components within each unit, enough to join all that are linked."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("node", "ascending"), ("against", "ascending")])
        unit, node, component, against = (table[c].to_pylist() for c in ("unit", "node", "component", "against"))
        text, a, b, start = table["text"], [], [], 0
        while start < len(unit):
            end = start
            while end < len(unit) and unit[end] == unit[start]:
                end += 1
            sets = [np.unique(np.concatenate(list(shingles(text[i].as_py().encode(), width)))) for i in range(start, end)]
            for i, j in _linked(sets, component[start:end], against[start:end], similarity):
                a.append(node[start + i])
                b.append(node[start + j])
            start = end
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.join(texts, "node").withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def similar(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """nodes(node, bytes, keys) and texts(node, text), distinct -> (node, component): components of links between nodes whose sets of shingles have a Jaccard similarity of at least `similarity`.

    Candidates share a key. A bucket is compared in blocks; of a bucket of several blocks, members that the first comparison
    has not joined to the bucket's largest component are then compared with all its blocks. No pairs but links leave a task.
    """
    each = nodes.select("node", "bytes", F.posexplode("keys").alias("t", "key"))
    sums = each.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("node").alias("least"), F.max("node").alias("most"), F.expr("bit_xor(xxhash64(node))").alias("sig")).where("n > 1")
    # buckets with the same members are compared once
    sums = written(sums.groupBy("n", "size", "least", "most", "sig").agg(F.min(F.struct("t", "key")).alias("of")).select("n", "size", "of.t", "of.key"), "buckets")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES))
    # most keys occur once: filters keep them, and the texts that share none, out of the shuffles
    sc = nodes.sparkSession.sparkContext
    held = written(passing(each, "key", sc.broadcast(bloom(sums, "key"))).join(sums.select("t", "key", blocks.alias("blocks")), ["t", "key"]).select("t", "key", "node", "bytes", "blocks", F.pmod(F.xxhash64("node", "t"), "blocks").alias("block")), "candidates")
    n, size = held.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(8, n // 2048, size // (4 << 20))
    texts = passing(texts, "node", sc.broadcast(bloom(written(held.select("node").distinct(), "members"), "node")))
    unit = F.xxhash64("t", "key", "block")
    first = _verified(held.select(unit.alias("unit"), "node", F.col("node").alias("component"), F.lit(True).alias("against")), texts, width, similarity, parts)
    joined = written(components(nodes.select("node"), written(first, "links"), "node"), "components")
    split = held.where("blocks > 1")
    if split.isEmpty():
        return joined
    split = written(split.join(joined, "node"), "split-buckets")
    per = split.groupBy("t", "key", "component").agg(F.count("*").alias("n"))
    largest = per.groupBy("t", "key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("n"))
    split = split.join(largest, ["t", "key"])
    apart = F.col("component") != F.col("main")
    chunks = split.where(apart).groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    split = split.join(chunks, ["t", "key"]).select("*", apart.alias("apart"))
    inside = split.select("t", "key", "node", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("against"))
    beside = split.where("apart").select("t", "key", "node", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), "chunks").alias("chunk"), F.lit(True).alias("against"))
    again = written(inside.unionByName(beside).select(F.xxhash64("t", "key", "block", "chunk").alias("unit"), "node", "component", "against"), "members")
    second = written(_verified(again, texts, width, similarity, max(parts, again.count() // 2048)), "links")
    # links of components
    of = joined.select("node", "component")
    ends = second.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    over = components(joined.select(F.col("component").alias("node")).distinct(), ends, "node").toDF("component", "over")
    return joined.join(over, "component").select("node", F.col("over").alias("component"))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 2, bands: int = 20, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates, all its columns.

    Rows link if their words (A-Z lower-cased) are the same, or if the Jaccard similarity of their sets of width-word shingles
    (fewer words: the whole sequence) is at least `similarity`; groups are what links reach. Links are found by the covering masks
    of the fingerprints of these shingles or by `bands` bands of `rows` minimum hashes (a pair of similarity s has none in common with
    a chance of (1 - s**rows)**bands, 0.0003 at 0.8), and verified. The row with the smallest id stays, of equal ids that with the
    smallest hash of the text; null ids come last. Rows with one id but texts that don't link all stay. Null texts count as
    empty; texts without words are one group. Column names don't matter; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    whole = docs.select(F.struct("*").alias("doc")).withColumn("text", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                texts = [t.encode() for t in part.column("text").to_pylist()]
                digests = np.array([np.frombuffer(_words_digest(t), np.int64) for t in texts]).reshape(-1, 2)
                keys = [candidate_keys(t, width, radius, bands, rows) for t in texts]
                yield pa.record_batch([pa.array(np.arange(at, at + len(part))), part.column("doc"), *(pa.array(d) for d in digests.T), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc", "k1", "k2", "keys"])
                at += len(part)

    longs = [StructField(c, LongType()) for c in ("row", "k1", "k2")]
    schema = StructType([longs[0], whole.schema["doc"], *longs[1:], StructField("keys", ArrayType(LongType()))])
    marked = written(whole.mapInArrow(run, schema), "marked")
    rank = F.struct(F.col("doc")[id_col].isNull(), F.col("doc")[id_col].alias("id"), F.xxhash64(text).alias("hash"), "row")
    nodes = written(marked.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min(rank)["row"].alias("first")), "nodes")
    worded = marked.where(F.size("keys") > 0)
    keyed = written(worded.select(F.col("row").alias("node"), F.octet_length(text).alias("bytes"), "keys").join(nodes.select("node"), "node", "left_semi"), "keys")
    found = similar(keyed, worded.select(F.col("row").alias("node"), text.alias("text")), width, similarity)
    # of a component that row stays which is first of its nodes' first rows
    labelled = nodes.join(found, "node", "left").select(F.col("first").alias("row"), F.coalesce("component", "node").alias("component"))
    ranked = labelled.join(marked.select("row", rank.alias("rank")), "row")
    chosen = written(ranked.groupBy("component").agg(F.min("rank")["row"].alias("row")).select("row"), "representatives")
    gone = written(marked.select("row").join(chosen, "row", "left_anti"), "gone")
    words = docs.sparkSession.sparkContext.broadcast(bloom(gone, "row"))
    rest = marked.select("row", "doc")
    return passing(rest, "row", words, False).unionByName(passing(rest, "row", words).join(gone, "row", "left_anti")).select("doc.*")


def _words_digest(text: bytes) -> bytes:
    """128 bits of hash of the lower-case words."""
    digest = xxhash.xxh3_128(seed=SEED)
    for words in word_runs(text, 1):
        digest.update(b" ".join([*words, b""]))
    return digest.digest()
