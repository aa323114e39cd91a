"""Joins, set operations and upserts: the translation memory, results, terms, boxes and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import glossary as A
from ..operators import memory as M
from ..operators import spatial as X
from ..operators import validate as V
from ..operators.ordering import numbered
from .catalog import query, table
from .text_queries import RUNS_SQL, runs, translatable

SEG_SQL = """seg AS (SELECT doc_id AS id, lang, text AS source, sha256('en' || chr(10) || 'kr' || chr(10) || text) AS key FROM documents),
tm AS (SELECT key, max(target) AS target FROM (SELECT key, upper(lang) || ':' || source AS target FROM seg WHERE id % 3 = 0) GROUP BY key)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("source"))
    return M.keyed(d)


def tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("id % 3 = 0")
    return s.select("key", F.concat(F.upper("lang"), F.lit(":"), "source").alias("target")).groupBy("key").agg(F.max("target").alias("target"))


@query(f"WITH {SEG_SQL} SELECT id, target FROM seg LEFT JOIN tm USING (key)")
def tm_lookup(spark, sf_dir):
    return M.lookup(segments(spark, sf_dir), tm(spark, sf_dir)).select("id", "target")


@query(f"WITH {SEG_SQL} SELECT id FROM seg WHERE key NOT IN (SELECT key FROM tm)")
def tm_misses(spark, sf_dir):
    return M.misses(segments(spark, sf_dir), tm(spark, sf_dir)).select("id")


@query(f"WITH {SEG_SQL} SELECT id FROM seg WHERE key IN (SELECT key FROM tm)")
def tm_hits(spark, sf_dir):
    return M.hits(segments(spark, sf_dir), tm(spark, sf_dir)).select("id")


@query(f"""WITH {SEG_SQL}, old AS (SELECT sha256(source) AS plain_key, max(CASE WHEN id % 2 = 0 THEN '한국 ' || id ELSE 'x' || id END) AS target FROM seg WHERE id % 5 = 0 GROUP BY 1)
SELECT id, coalesce(tm.target, old.target) AS target FROM seg LEFT JOIN tm USING (key) LEFT JOIN old ON sha256(source) = plain_key AND regexp_matches(old.target, '{T.HANGUL}')""")
def tm_lookup_legacy(spark, sf_dir):
    s = segments(spark, sf_dir)
    value = F.when(F.col("id") % 2 == 0, F.concat(F.lit("한국 "), "id")).otherwise(F.concat(F.lit("x"), "id"))
    old = s.where("id % 5 = 0").groupBy(F.sha2("source", 256).alias("plain_key")).agg(F.max(value).alias("target")).where(F.col("target").rlike(T.HANGUL))
    return M.lookup_with_legacy(s, tm(spark, sf_dir), old).select("id", "target")


@query(f"WITH {SEG_SQL} SELECT id, CASE WHEN target IS NOT NULL THEN 'tm-hit' WHEN NOT {translatable('source')} THEN 'not-translatable-source-copy' ELSE 'pending' END AS status FROM seg LEFT JOIN tm USING (key)")
def route_status(spark, sf_dir):
    return M.routed(M.lookup(segments(spark, sf_dir), tm(spark, sf_dir))).select("id", "status")


@query(f"""WITH {SEG_SQL}, r AS (SELECT lang, CASE WHEN target IS NOT NULL THEN 'tm-hit' WHEN NOT {translatable('source')} THEN 'not-translatable-source-copy' ELSE 'pending' END AS status FROM seg LEFT JOIN tm USING (key))
SELECT lang, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'tm-hit') AS tm_hit, count(*) FILTER (contains(status, 'copy')) AS source_copy FROM r GROUP BY lang""")
def status_stats(spark, sf_dir):
    r = M.routed(M.lookup(segments(spark, sf_dir), tm(spark, sf_dir)))
    s = F.col("status")
    return r.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "tm-hit").alias("tm_hit"), F.count_if(F.contains(s, F.lit("copy"))).alias("source_copy"))


RES_SQL = "res AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END AS id, 'T' || doc_id AS translated, doc_id AS seq FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'again' || doc_id, doc_id + 5000000 FROM documents WHERE doc_id % 9 = 1)"


def results(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    a = d.where("doc_id % 4 <> 0").select((i + F.when(i % 10 == 0, 1000000).otherwise(0)).alias("id"), F.concat(F.lit("T"), i).alias("translated"), i.alias("seq"))
    return a.unionByName(d.where("doc_id % 9 = 1").select(i.alias("id"), F.concat(F.lit("again"), i).alias("translated"), (i + 5000000).alias("seq")))


@query(f"WITH {RES_SQL} SELECT doc_id AS id, translated FROM documents JOIN res ON doc_id = id")
def attach_results_inner(spark, sf_dir):
    return V.attach(segments(spark, sf_dir), results(spark, sf_dir), False).select("id", "translated")


@query(f"WITH {RES_SQL} SELECT doc_id AS id, coalesce(translated, text) AS translated FROM documents LEFT JOIN res ON doc_id = id")
def attach_results_left(spark, sf_dir):
    return V.attach(segments(spark, sf_dir), results(spark, sf_dir), True).select("id", "translated")


@query(f"""WITH {RES_SQL} SELECT doc_id AS id, 'missing-id' AS code FROM documents WHERE doc_id NOT IN (SELECT id FROM res) UNION ALL SELECT DISTINCT id, 'unknown-id' FROM res WHERE id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT id, 'duplicate-id' FROM res GROUP BY id HAVING count(*) > 1""")
def validate_ids(spark, sf_dir):
    return V.id_issues(segments(spark, sf_dir), results(spark, sf_dir))


@query(f"WITH {RES_SQL} (SELECT doc_id AS id, 'requested' AS side FROM documents EXCEPT SELECT id, 'requested' FROM res) UNION ALL (SELECT id, 'returned' FROM res EXCEPT SELECT doc_id, 'returned' FROM documents)")
def id_difference(spark, sf_dir):
    a, b = segments(spark, sf_dir).select("id"), results(spark, sf_dir).select("id")
    return a.subtract(b).withColumn("side", F.lit("requested")).unionByName(b.subtract(a).withColumn("side", F.lit("returned")))


@query(f"WITH {RES_SQL} SELECT doc_id AS id FROM documents UNION SELECT id FROM res")
def key_union(spark, sf_dir):
    return segments(spark, sf_dir).select("id").union(results(spark, sf_dir).select("id")).distinct()


@query(f"WITH {RES_SQL}, l AS (SELECT id, arg_max(translated, seq) AS translated FROM res GROUP BY id) SELECT doc_id AS id, coalesce(translated, text) AS translated FROM documents LEFT JOIN l ON doc_id = id")
def merge_degraded(spark, sf_dir):
    return V.merged_degraded(segments(spark, sf_dir), results(spark, sf_dir)).select("id", "translated")


@query(f"WITH {SEG_SQL} SELECT id, target, 'cache' AS origin FROM seg JOIN tm USING (key) UNION ALL SELECT id, 'fresh ' || id, 'fresh' FROM seg WHERE key NOT IN (SELECT key FROM tm)")
def union_cached_fresh(spark, sf_dir):
    s, t = segments(spark, sf_dir), tm(spark, sf_dir)
    cached = s.join(t, "key").select("id", "target", F.lit("cache").alias("origin"))
    return cached.unionByName(M.misses(s, t).select("id", F.concat(F.lit("fresh "), "id").alias("target"), F.lit("fresh").alias("origin")))


@query("""WITH a AS (SELECT doc_id AS k, text AS v FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN 'x' || text ELSE text END AS v FROM documents WHERE doc_id % 6 <> 0)
SELECT k, coalesce(a.v, '') AS before, coalesce(b.v, '') AS after FROM a FULL JOIN b USING (k) WHERE coalesce(a.v, '') <> coalesce(b.v, '')""")
def keyed_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = F.col("text")
    k = F.col("doc_id").alias("k")
    return V.keyed_diff(d.where("doc_id % 7 <> 0").select(k, s.alias("v")), d.where("doc_id % 6 <> 0").select(k, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), s)).otherwise(s).alias("v")), "k", "v")


TERMS = ["the", "with", "ung", "ción", "eaux"]


@query("""WITH terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT unnest(['the', 'with', 'ung', 'ción', 'eaux']) UNION SELECT DISTINCT source FROM documents)
SELECT doc_id AS id, term FROM documents JOIN terms ON contains(text, term) WHERE NOT contains(lang || ' ' || reverse(text), term)""")
def term_violations(spark, sf_dir):
    """Terms that a source has and its result lacks. The glossary: words of part names, sources and some endings."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    terms = names.unionByName(spark.createDataFrame([(t,) for t in TERMS], "term string")).unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("term")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", "lang", F.reverse("text")).alias("result"))
    return A.violations(d, terms, "text", "result").select("id", "term")


TABLES_SQL = 'tables AS (SELECT page, ord, "left" - 60 AS tl, top - 60 AS tt, "right" + 60 AS tr, bottom + 90 AS tb FROM runs WHERE ord % 10 = 3)'


@query(f"""WITH {RUNS_SQL}, {TABLES_SQL}, hit AS (SELECT r.ord, t.ord AS table_ord, row_number() OVER (PARTITION BY r.ord ORDER BY t.ord) AS n FROM runs r JOIN tables t ON r.page = t.page AND ("left" + "right") / 2 BETWEEN tl AND tr AND (top + bottom) / 2 BETWEEN tt AND tb)
SELECT r.ord, table_ord FROM runs r LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON r.ord = h.ord""")
def spatial_containment(spark, sf_dir):
    r = runs(spark, sf_dir)
    t = r.where("ord % 10 = 3").select("page", F.col("ord").alias("table_ord"), (F.col("left") - 60).alias("left"), (F.col("top") - 60).alias("top"), (F.col("right") + 60).alias("right"), (F.col("bottom") + 90).alias("bottom"))
    first = X.centres_inside(r, t, ["page"]).groupBy("ord").agg(F.min("table_ord").alias("table_ord"))
    return r.select("ord").join(first, "ord", "left")


@query(f"""WITH {RUNS_SQL}, p AS (SELECT a.ord, b.ord AS near, abs(a."left" - b."left") + abs(a.top - b.top) AS d, row_number() OVER (PARTITION BY a.ord ORDER BY abs(a."left" - b."left") + abs(a.top - b.top), b.ord) AS n FROM runs a JOIN runs b ON a.page = b.page AND a.ord % 2 = 0 AND b.ord % 2 = 1 AND (contains(a.text, b.text) OR contains(b.text, a.text)))
SELECT ord, near, d FROM p WHERE n = 1""")
def nearest_match(spark, sf_dir):
    """Of the runs whose text holds the other's, or the other way round, the nearest."""
    r = runs(spark, sf_dir)
    a, b = r.where("ord % 2 = 0"), r.where("ord % 2 = 1").withColumnRenamed("ord", "near")
    return X.nearest_holding(a, b, ["page"], "ord", "near")


@query(f"WITH {RUNS_SQL}, sizes AS (SELECT DISTINCT page, 500.0 + page AS w, 700.0 + page AS h FROM runs WHERE page % 3 = 0) SELECT ord, coalesce(w, 612.0) AS w, coalesce(h, 792.0) AS h FROM runs LEFT JOIN sizes USING (page)")
def page_size_default(spark, sf_dir):
    r = runs(spark, sf_dir)
    sizes = r.where("page % 3 = 0").select("page", (500.0 + F.col("page")).alias("w"), (700.0 + F.col("page")).alias("h")).distinct()
    return r.join(sizes, "page", "left").select("ord", F.coalesce("w", F.lit(612.0)).alias("w"), F.coalesce("h", F.lit(792.0)).alias("h"))


@query("""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 = 0), b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id % 4 = 0)
SELECT a.doc_id AS source_id, b.doc_id AS output_id FROM a JOIN b USING (lang, n)""")
def positional_zip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    a = numbered(d.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "source_id"), ["lang"], "source_id")
    b = numbered(d.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "output_id"), ["lang"], "output_id")
    return a.join(b, ["lang", "n"]).select("source_id", "output_id")


@query(f"WITH {RUNS_SQL} SELECT ord, length(text) AS units, \"right\" - \"left\" AS room FROM runs WHERE length(text) * font * 0.58 > \"right\" - \"left\"")
def layout_overflow(spark, sf_dir):
    room = F.col("right") - F.col("left")
    return runs(spark, sf_dir).where(F.length("text") * F.col("font") * 0.58 > room).select("ord", F.length("text").alias("units"), room.alias("room"))


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 1)")
def skip_set(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(d.where("doc_id % 3 = 1").select("text"), "text", "left_anti").select("doc_id")


@query("SELECT event_type, user_id % 20 AS k, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("k"), "event_id", "value")
    return M.upsert(e, ["event_type", "k"], "event_id")


@query("SELECT event_type, user_id % 20 AS k, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("k"), "event_id", "value")
    return M.upsert(e, ["event_type", "k"], "event_id", last_wins=False)


@query(f"""WITH {SEG_SQL}, m AS (SELECT key, source, CASE WHEN id % 2 = 0 THEN source ELSE 'T' || id END AS target, id AS seq FROM seg WHERE id % 3 = 0), f AS (SELECT key, source, CASE WHEN id % 4 = 1 THEN source ELSE 'F' || id END AS target, id + 1000000 AS seq FROM seg WHERE id % 5 = 0)
SELECT key, arg_max(target, seq) AS target FROM (SELECT * FROM m UNION ALL SELECT * FROM f) WHERE target <> source GROUP BY key""")
def tm_self_heal(spark, sf_dir):
    s = segments(spark, sf_dir)
    i = F.col("id")
    part = lambda rows, bad, mark, add: rows.select("key", "source", F.when(bad, F.col("source")).otherwise(F.concat(F.lit(mark), i)).alias("target"), (i + add).alias("seq"))
    return M.healed(part(s.where("id % 3 = 0"), i % 2 == 0, "T", 0), part(s.where("id % 5 = 0"), i % 4 == 1, "F", 1000000)).select("key", "target")


@query("""WITH t AS (SELECT p_brand AS term, 'auto' AS mode, 0 AS pri, min(p_partkey) AS k FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'glossary', 1, min(p_partkey) FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 UNION ALL SELECT p_brand, 'job', 2, min(p_partkey) FROM part WHERE p_partkey % 50 = 0 GROUP BY 1)
SELECT term, arg_max(mode, pri) AS mode, arg_max(k, pri) AS k FROM t GROUP BY term""")
def term_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tier = lambda rows, mode, pri: rows.groupBy(F.col("p_brand").alias("term")).agg(F.min("p_partkey").alias("k")).select("term", F.lit(mode).alias("mode"), F.lit(pri).alias("pri"), "k")
    every = tier(p, "auto", 0).unionByName(tier(p.where("p_partkey % 3 = 0"), "glossary", 1)).unionByName(tier(p.where("p_partkey % 50 = 0"), "job", 2))
    return M.upsert(every, ["term"], "pri").select("term", "mode", "k")


@query("""WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE '  ' || p_name || ' ' END AS term, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS translation, CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'yes' ELSE '' END AS protected FROM part)
SELECT p_partkey, trim(term) AS term, translation, protected = 'true' AS strict_protected, lower(protected) IN ('1', 'true', 'yes') AS loose_protected, CASE WHEN translation IS NULL THEN 'preserve' ELSE 'fixed' END AS mode FROM g WHERE trim(term) <> ''""")
def glossary_normalize(spark, sf_dir):
    from ..sources.glossary import normalized_glossary

    i = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select("p_partkey", F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("source_term"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("Target"), F.when(i % 4 == 0, "true").when(i % 4 == 1, "TRUE").when(i % 4 == 2, "yes").otherwise("").alias("protected"))
    return normalized_glossary(g, keep=["p_partkey"])
