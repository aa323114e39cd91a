"""Translation memory: content-hash keys, lookups, splits and upserts, as joins and grouped maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def keyed(segments: DataFrame, source_lang: str = "en", target_lang: str = "kr", text: str = "source") -> DataFrame:
    return segments.withColumn("key", T.cache_key(F.lit(source_lang), F.lit(target_lang), F.col(text)))


def lookup(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """All segments, with target where the memory(key, target) has their key. Spark broadcasts the memory if it is small."""
    return segments.join(memory.select("key", "target"), "key", "left")


def misses(segments: DataFrame, memory: DataFrame) -> DataFrame:
    return segments.join(memory, "key", "left_anti")


def hits(segments: DataFrame, memory: DataFrame) -> DataFrame:
    return segments.join(memory, "key", "left_semi")


def lookup_with_legacy(segments: DataFrame, memory: DataFrame, legacy: DataFrame) -> DataFrame:
    """The language-qualified key first, then the hash of the text alone in legacy(plain_key, target)."""
    found = lookup(segments, memory).withColumnRenamed("target", "first")
    old = legacy.select(F.col("plain_key"), F.col("target").alias("second"))
    return found.withColumn("plain_key", F.sha2("source", 256)).join(old, "plain_key", "left").withColumn("target", F.coalesce("first", "second")).drop("first", "second")


def routed(segments: DataFrame, provider: bool = True) -> DataFrame:
    """A status per segment after lookup(): hit, not translatable, pending, or copy if there is no provider."""
    return segments.withColumn("status", F.when(F.col("target").isNotNull(), "tm-hit").when(~T.is_translatable(F.col("source")), "not-translatable-source-copy").otherwise("pending" if provider else "source-copy"))


def upsert(rows: DataFrame, keys: list[str], order: str, last_wins: bool = True) -> DataFrame:
    """One row per key: the one with the greatest (or least) order. A grouped maximum of a struct: no sort, map-side combined."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max if last_wins else F.min
    one = rows.groupBy(*keys).agg(pick(F.struct(order, *(c for c in rest if c != order))).alias("_r"))
    return one.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def healed(memory: DataFrame, fresh: DataFrame, order: str = "seq") -> DataFrame:
    """The memory without entries that only repeat their source, with fresh results (key, source, target, seq) added, later ones winning."""
    good: Column = F.col("target") != F.col("source")
    return upsert(memory.where(good).unionByName(fresh.where(good)), ["key"], order)
