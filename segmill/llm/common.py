"""What several of the operators share: the work folder, tables that cut lineage, components, bounded Bloom filters, hashes of substrings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it: 0x20 and 0x09 to 0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="segmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/segmill"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about most bytes of text (one row at least), so that memory doesn't follow the batch size."""
    values = batch.column(column)
    if not len(values):
        return
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    start = 0
    while start < len(values):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(len(values), max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """nodes(id) and edges(a, b) -> (id, component): the smallest id that links reach.

    Alternating large-star and small-star steps; each is a grouped minimum and an equi-join, so no group is ever gathered,
    and each round's edges are written to the shared folder. Edges between the same id are ignored; ends that nodes lacks count as nodes of the paths only.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        stars = written(small, "edges")
    return nodes.join(stars.select(F.col("a").alias(node), F.col("b").alias("component")), node, "left").select(node, F.coalesce("component", node).alias("component"))


#: Bits of the largest filter, as a power of two: 32 MB.
MOST_BITS = 28


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    first = mixed(keys)
    return [first >> np.uint64(64 - bits), first & np.uint64((1 << bits) - 1), mixed(first + np.uint64(1)) >> np.uint64(64 - bits)]


def bloom(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter of keys, a written table: about ten bits a key, 2**most_bits bits at most, three probes a key; uint64 words.

    Only a filter: what passes it is held against the keys themselves later. With more than about 2**most_bits / 4 keys it
    passes more, and what follows costs more. Words are or-ed by Spark; at most 2**(most_bits-6) come to the driver.
    """
    bits = min(most_bits, max(16, int(10 * keys.count()).bit_length()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(_probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))
            if len(p):
                word, one = p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63))
                at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                yield pa.record_batch([pa.array(word[at].astype(np.int64)), pa.array(np.bitwise_or.reduceat(one, at).view(np.int64))], ["w", "v"])

    table = keys.select(key).where(F.col(key).isNotNull()).mapInArrow(probe, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["w"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    return out


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key (int64 or uint64) may be in the filter."""
    bits = int(len(words)).bit_length() + 5
    out = np.ones(len(keys), bool)
    for p in _probes(keys.view(np.uint64), bits):
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def passing(df: DataFrame, column: str, words, inside: bool = True) -> DataFrame:
    """The rows whose key (a long) may be in a broadcast filter, or those whose key certainly isn't: a join needs to shuffle the first alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(words.value, batch.column(column).to_numpy()) == inside))

    return df.mapInArrow(run, df.schema)


_rng = np.random.default_rng(6)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_R, pow(_R, -1, 2**64))):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


class Rolling:
    """64-bit hashes of any substrings of one buffer, by prefix sums."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mixed((self.sums[j] - self.sums[i]) * self.down[i])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])
