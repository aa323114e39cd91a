"""The link taxonomy: categories of diagrams, flat or in subcategories, joined with scraped links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug_key, url_host

DIAGRAMS = "array<struct<title:string,url:string>>"


def flattened(index: DataFrame) -> DataFrame:
    """index(category, json): a list of diagrams, or lists by subcategory -> (category, subcategory, ord, title, url, key)."""
    flat = index.where(F.ltrim("json").startswith("[")).select("category", F.lit(None).cast("string").alias("subcategory"), F.from_json("json", DIAGRAMS).alias("d"))
    nested = index.where(F.ltrim("json").startswith("{")).select("category", F.explode(F.from_json("json", f"map<string,{DIAGRAMS}>")).alias("subcategory", "d"))
    rows = flat.unionByName(nested).select("category", "subcategory", F.posexplode("d").alias("ord", "x"))
    return rows.select("category", "subcategory", "ord", "x.title", "x.url").withColumn("key", slug_key(F.col("title")))


def scraped(files: DataFrame) -> DataFrame:
    """files(category, json): links by diagram key -> (category, key, link_ord, link_title, link_url)."""
    rows = files.select("category", F.explode(F.from_json("json", f"map<string,{DIAGRAMS}>")).alias("key", "l"))
    return rows.select("category", "key", F.posexplode("l").alias("link_ord", "x")).select("category", "key", "link_ord", F.col("x.title").alias("link_title"), F.col("x.url").alias("link_url"))


def joined(diagrams: DataFrame, links: DataFrame, noise: list[str]) -> DataFrame:
    """Every diagram with its links: first of each URL within a diagram, no noisy hosts; a diagram without links keeps a row of nulls."""
    first = links.where(~url_host(F.col("link_url")).isin(*noise)).groupBy("category", "key", "link_url").agg(F.min(F.struct("link_ord", "link_title")).alias("f")).select("category", "key", "link_url", "f.link_ord", "f.link_title")
    return diagrams.join(first, ["category", "key"], "left")


def statistics(rows: DataFrame) -> DataFrame:
    """Links and distinct URLs per diagram, category and in all (nulls in a key: all of it)."""
    return rows.rollup("category", "key").agg(F.count("link_url").alias("links"), F.countDistinct("link_url").alias("urls"))


def totals(diagrams: DataFrame, links: DataFrame, noise: list[str]) -> DataFrame:
    """(category, diagrams, raw, per_diagram, unique_urls, filtered): a row a category, and one of nulls for all together.

    raw: links as scraped, of the diagrams in the index; per_diagram: those left after noise and repeated URLs of a diagram; unique_urls: distinct
    among these in the category, or in all; filtered: raw less per_diagram.
    """
    own = diagrams.select("category", "key").distinct()
    raw = links.join(own, ["category", "key"], "left_semi").groupBy("category", "key").agg(F.count("*").alias("raw"))
    kept = joined(own, links, noise)
    counted = kept.groupBy("category", "key").agg(F.count("link_url").alias("per_diagram")).join(raw, ["category", "key"], "left")
    sums = counted.rollup("category").agg(F.count("*").alias("diagrams"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.sum("per_diagram").alias("per_diagram"))
    urls = kept.rollup("category").agg(F.countDistinct("link_url").alias("unique_urls"))
    both = sums.alias("s").join(urls.alias("u"), F.col("s.category").eqNullSafe(F.col("u.category")))
    return both.select("s.category", "diagrams", "raw", "per_diagram", "unique_urls", (F.col("raw") - F.col("per_diagram")).alias("filtered"))


def sketched(rows: DataFrame, keys: list[str], url: str = "link_url", size: int = 14) -> DataFrame:
    """(keys, urls, n): a sketch of the distinct URLs and the number of rows, to be stored with a run and merged with those of others."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(url, F.lit(size)).alias("urls"), F.count(url).alias("n"))


def merged_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Of sketches of any number of runs: (keys, urls, n) over all of them. Merging again, or in another order, gives the same sketch."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("urls").alias("urls"), F.sum("n").alias("n"))


def estimated(stored: DataFrame) -> DataFrame:
    """stored with unique_urls, the estimate of its sketches (within about one percent)."""
    return stored.withColumn("unique_urls", F.hll_sketch_estimate("urls"))
