"""Checks of results against what was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_issues(requested: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    """(id, code): missing-id, unknown-id and duplicate-id."""
    missing = requested.select(key).distinct().join(returned, key, "left_anti").select(key, F.lit("missing-id").alias("code"))
    unknown = returned.select(key).distinct().join(requested, key, "left_anti").select(key, F.lit("unknown-id").alias("code"))
    twice = returned.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate-id").alias("code"))
    return missing.unionByName(unknown).unionByName(twice)


def keyed_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of keys whose values differ; a missing side is ''."""
    a, b = left.select(key, F.col(value).alias("before")), right.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    return both.where("before <> after")


def attach(segments: DataFrame, results: DataFrame, keep_all: bool, key: str = "id") -> DataFrame:
    """Results by id: without one, a segment goes (inner) or keeps its source."""
    joined = segments.join(results, key, "left" if keep_all else "inner")
    return joined.withColumn("translated", F.coalesce("translated", "source")) if keep_all else joined


def merged_degraded(requested: DataFrame, results: DataFrame, order: str = "seq", key: str = "id") -> DataFrame:
    """One result per requested id: the last one returned, or the source."""
    last = results.join(requested.select(key), key, "left_semi").groupBy(key).agg(F.max_by("translated", order).alias("translated"))
    return attach(requested, last, True, key)
