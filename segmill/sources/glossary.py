"""Glossary and translation-memory CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names that mean the same, in order of preference.
TERM, TRANSLATION = ("term", "source", "source_term", "src"), ("translation", "target", "target_term", "tgt")


def _alias(rows: DataFrame, names: tuple[str, ...]) -> Column:
    by_lower = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
    found = [F.col(f"`{by_lower[n]}`") for n in names if n in by_lower]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalized_glossary(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, term, translation, strict_protected, loose_protected, mode): terms trimmed, blank ones gone.

    strict_protected takes 'true' alone, loose_protected also 1, yes and other cases. mode: the given one, or else fixed with a
    translation and preserve without.
    """
    term, translation, flag, mode = F.btrim(_alias(rows, TERM)), F.nullif(F.btrim(_alias(rows, TRANSLATION)), F.lit("")), F.coalesce(_alias(rows, ("protected",)), F.lit("")), F.nullif(F.btrim(_alias(rows, ("mode",))), F.lit(""))
    out = rows.select(*(keep or []), term.alias("term"), translation.alias("translation"), (flag == "true").alias("strict_protected"), F.lower(flag).isin("1", "true", "yes").alias("loose_protected"), F.coalesce(F.lower(mode), F.when(translation.isNull(), "preserve").otherwise("fixed")).alias("mode"))
    return out.where("term <> ''")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return normalized_glossary(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8"))


def read_memory(spark: SparkSession, path: str, source_lang: str = "en", target_lang: str = "kr", header: bool = True) -> DataFrame:
    """(source, target, source_lang, target_lang): by header aliases with languages per row, or by position; rows of one column go."""
    rows = spark.read.csv(path, header=header, quote='"', escape='"', multiLine=True)
    if header:
        source, target = _alias(rows, ("source", "src", "term")), _alias(rows, ("target", "tgt", "translation"))
        langs = [F.coalesce(_alias(rows, (n,)), F.lit(d)).alias(n) for n, d in (("source_lang", source_lang), ("target_lang", target_lang))]
    else:
        source, target = F.col(rows.columns[0]), F.col(rows.columns[1]) if len(rows.columns) > 1 else F.lit(None).cast("string")
        langs = [F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang")]
    return rows.select(source.alias("source"), target.alias("target"), *langs).where("source is not null and target is not null")
