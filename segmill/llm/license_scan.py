"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings no longer matter) and its
digest is joined with those of known licences. Whole texts are looked up, and each line as a text of its own, since licence
notices stand alone on a line. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licences import LICENCES

#: Fixed values, applied in this order to both sides: spellings that count as equal. Rules may go beyond the word they are
#: meant for; as they apply to licences and texts alike, only equality matters.
SPELLINGS = [
    ("licenc", "licens"),
    ("is(e|ed|es|ing|ation|ations)( |$)", "iz\\1\\2"),
    ("our(ed|s|ite)?( |$)", "or\\1\\2"),
    ("(cent|met|lit)re(s?)( |$)", "\\1er\\2\\3"),
    ("ogue(s?)( |$)", "og\\1\\2"),
    ("dgement", "dgment"),
    ("ll(ed|ing)( |$)", "l\\1\\2"),
    ("whilst", "while"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent( |$)", "percent\\1"),
    ("copyright (owner|holder)", "copyright holder"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that opens with a notice: the word or sign with a year or a place for one, or "all rights reserved".
COPYRIGHT_LINE = "^[^a-z0-9©\n]*(copyright[^a-z0-9\n]*(\\(c\\)|©|[0-9]{4}|year|yyyy)|©|\\(c\\)[^a-z0-9\n]*[0-9]{4}|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, letters and digits only with single spaces between, one spelling."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), "(?m)" + COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def known(spark, licences: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence), one row per digest: as many as licences."""
    rows = spark.createDataFrame(list((LICENCES if licences is None else licences).items()), "licence string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, digest, licence, n_notices, notices): a row per row of docs.

    digest: of the canonical whole text; licence: that with this digest, or null. n_notices: lines that are a known text;
    notices: their licences, sorted, distinct, comma-separated ('' if none). Null texts count as empty; a text with nothing left
    (empty, blank, copyright lines alone) matches nothing. Null ids and repeated rows each give a row. Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text"))), F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text"))))
    each = rows.select("id", "row", F.explode(units).alias("u")).select("id", "row", "u.whole", canonical(F.col("u.text")).alias("canon"))
    each = each.select("id", "row", "whole", F.sha2("canon", 256).alias("digest"), (F.col("canon") != "").alias("full"))
    table = F.broadcast(known(docs.sparkSession, licences))  # a fixed number of rows
    hit = each.join(table, "digest", "left").withColumn("licence", F.when(F.col("full"), F.col("licence")))
    # the lines of a text are in one partition: the partial aggregate leaves one row per text
    out = hit.groupBy("row", "id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.count_if(~F.col("whole") & F.col("licence").isNotNull()).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("notices"),
    )
    return out.select(F.col("id").alias(id_col), "digest", "licence", "n_notices", "notices")


def scan_sql(licences: dict[str, str] | None = None) -> str:
    """The same in DuckDB SQL over documents."""

    def canon(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g')"
        x = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
        return x

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (LICENCES if licences is None else licences).items())
    return f"""
WITH known AS (SELECT sha256({canon('t')}) AS digest, min(l) AS licence FROM (VALUES {values}) AS v(l, t) GROUP BY 1),
units AS (
  SELECT doc_id, true AS whole, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
canon AS (SELECT doc_id, whole, {canon('t')} AS c FROM units),
hit AS (SELECT doc_id, whole, sha256(c) AS d, CASE WHEN c <> '' THEN licence END AS licence FROM canon LEFT JOIN known ON sha256(c) = known.digest)
SELECT doc_id, max(CASE WHEN whole THEN d END) AS digest, max(CASE WHEN whole THEN licence END) AS licence,
  count(*) FILTER (NOT whole AND licence IS NOT NULL) AS n_notices,
  coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (NOT whole AND licence IS NOT NULL), '') AS notices
FROM hit GROUP BY doc_id"""
