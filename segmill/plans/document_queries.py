"""Manifests, drawing operators, table cells and lines put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as X
from .catalog import query, table

PREFIX = r"^(\s*(?:(?:[-*+]|[0-9]+[.)]|>|#{1,6})\s+)?)"


@query("""WITH s AS (SELECT event_id // 20 AS stream, string_agg(CASE event_id % 4 WHEN 0 THEN 'BT' WHEN 1 THEN '(x) Tj' WHEN 2 THEN 'ET' ELSE 'Tjx q' END, ' ' ORDER BY event_id) AS c FROM events GROUP BY 1), t AS (SELECT stream, unnest(string_split(c, ' ')) AS op FROM s)
SELECT stream, op, count(*) AS n FROM t WHERE op IN ('BT', 'ET', 'Tj', 'q', 'Q') GROUP BY stream, op""")
def operator_counts(spark, sf_dir):
    k = F.col("event_id") % 4
    piece = F.when(k == 0, "BT").when(k == 1, "(x) Tj").when(k == 2, "ET").otherwise("Tjx q")
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("stream"), F.explode(F.split(piece, " ")).alias("op"))
    return e.where(F.col("op").isin("BT", "ET", "Tj", "q", "Q")).groupBy("stream", "op").agg(F.count("*").alias("n"))


@query("SELECT event_id // 4 AS line, '| ' || string_agg(upper(event_type), ' | ' ORDER BY event_id % 4) || ' |' AS row_text FROM events GROUP BY 1")
def apply_table_cells(spark, sf_dir):
    cell = F.struct((F.col("event_id") % 4).alias("i"), F.upper("event_type").alias("t"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["t"]), " | ")
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 4).alias("line")).agg(F.concat(F.lit("| "), row, F.lit(" |")).alias("row_text"))


@query(f"""WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  - ' WHEN 1 THEN '## ' WHEN 2 THEN '> ' WHEN 3 THEN '12. ' ELSE '   ' END || replace(text, chr(10), ' ') || '  ' AS line FROM documents)
SELECT doc_id, regexp_extract(line, '{PREFIX}', 1) || 'NEW' || regexp_extract(line, '(\\s*)$', 1) AS line FROM l""")
def reassemble_line(spark, sf_dir):
    m = F.col("doc_id") % 5
    line = F.concat(F.when(m == 0, "  - ").when(m == 1, "## ").when(m == 2, "> ").when(m == 3, "12. ").otherwise("   "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", X.reassembled(line, F.lit("NEW"), PREFIX).alias("line"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '\\.([a-z]+)/', 1) IN ('org', 'net') THEN 'ready' ELSE 'skipped' END AS status, CASE WHEN regexp_extract(url, '\\.([a-z]+)/', 1) IN ('org', 'net') THEN NULL ELSE 'unsupported: ' || regexp_extract(url, '\\.([a-z]+)/', 1) END AS reason FROM pages")
def format_filter(spark, sf_dir):
    kind = F.regexp_extract("url", r"\.([a-z]+)/", 1)
    ok = kind.isin("org", "net")
    return table(spark, sf_dir, "pages").select("page_id", F.when(ok, "ready").otherwise("skipped").alias("status"), F.when(~ok, F.concat(F.lit("unsupported: "), kind)).alias("reason"))


@query("""WITH o AS (SELECT event_id // 50 AS page, event_type AS kind, user_id AS xref, event_id % 5 AS x, event_id AS ord, value AS width FROM events),
i AS (SELECT * FROM o WHERE kind = 'click' AND xref > 0 QUALIFY row_number() OVER (PARTITION BY page, xref, x ORDER BY ord) = 1)
SELECT page, count(*) AS objects, count(*) FILTER (kind <> 'click') AS others, (SELECT count(*) FROM i WHERE i.page = o.page) AS images, (SELECT string_agg(xref || ':' || x, ' ' ORDER BY ord) FROM i WHERE i.page = o.page) AS image_list, round(max(width), 6) AS widest FROM o GROUP BY page""")
def object_manifest(spark, sf_dir):
    """A manifest of each page's objects as JSON, and what is read from it: images once per place, as they come, and the other objects."""
    entry = F.struct(F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.col("user_id").alias("xref"), (F.col("event_id") % 5).alias("x"), F.col("value").alias("width"))
    pages = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("json"))
    rows = pages.select("page", F.explode(F.from_json("json", "array<struct<ord:long,kind:string,xref:long,x:long,width:double>>")).alias("o")).select("page", "o.*")
    image = (F.col("kind") == "click") & (F.col("xref") > 0)
    first = rows.where(image).groupBy("page", "xref", "x").agg(F.min("ord").alias("ord")).groupBy("page").agg(F.count("*").alias("images"), F.array_sort(F.collect_list(F.struct("ord", "xref", "x"))).alias("found"))
    listed = first.select("page", "images", F.array_join(F.transform("found", lambda i: F.concat_ws(":", i["xref"], i["x"])), " ").alias("image_list"))
    every = rows.groupBy("page").agg(F.count("*").alias("objects"), F.count_if(F.col("kind") != "click").alias("others"), F.round(F.max("width"), 6).alias("widest"))
    return every.join(listed, "page", "left").select("page", "objects", "others", F.coalesce("images", F.lit(0)).alias("images"), "image_list", "widest")


@query("""WITH p AS (SELECT page_id, replace(url, '&', '&amp;') AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, CASE WHEN title = '' THEN '<p><b>x</b>' || url || '<i>end</i></p>' ELSE '<p>No. ' || page_id || ': ' || title || '<b>' || url || '</b>' || 'tail<i>' || title || '</i></p>' END AS xhtml, CASE WHEN title = '' THEN 1 ELSE 3 END AS applied FROM p""")
def edit_by_path(spark, sf_dir):
    """The title of each page in a tree of its own; three texts are replaced, two paths end at no text."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    tree = F.concat(F.lit("<p>"), F.coalesce("title", F.lit("none")), F.lit("<b>x</b>tail<i>end</i></p>"))
    edit = lambda path, text: F.struct(F.array(*map(F.lit, path)).alias("path"), text.alias("text"))
    url, title = X.escaped(F.col("url")), F.col("title")  # a title is markup, and may end amid an entity
    full = F.array(edit([0], F.concat(F.lit("No. "), "page_id", F.lit(": "), title)), edit([1, 0], url), edit([3, 0], title), edit([7], F.lit("none")), edit([1], F.lit("none")))
    bare = F.array(edit([1], url), edit([7], F.lit("none")))
    return p.select("page_id", X.edited(tree, F.when(F.col("title") == "", bare).otherwise(full)).alias("e")).select("page_id", "e.*")
