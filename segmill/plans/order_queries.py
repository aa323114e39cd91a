"""Deduplication, context, numbering, batches and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from .catalog import query, table
from .text_queries import RUNS_SQL, runs, strip

LINKS_SQL = "links AS (SELECT page_id AS ord, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS category, regexp_replace(url, '/[0-9]+.*$', '') AS url FROM pages)"


def links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("category"), F.regexp_replace("url", "/[0-9]+.*$", "").alias("url"))


@query(f"WITH {LINKS_SQL} SELECT category, url, min(ord) AS ord FROM links GROUP BY category, url")
def dedup_keep_first(spark, sf_dir):
    return O.keep_first(links(spark, sf_dir), ["category", "url"], ["ord"])


@query(f"WITH {LINKS_SQL} SELECT category, url, ord FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY category, ord) = 1")
def dedup_global(spark, sf_dir):
    return O.keep_first(links(spark, sf_dir), ["url"], ["category", "ord"])


LINES_SQL = """lines AS (SELECT doc_id, i - 1 AS line_index, CASE WHEN (doc_id + i) % 11 = 0 THEN '## Part ' || i WHEN (doc_id + i) % 17 = 0 THEN '```' WHEN i = 1 AND doc_id % 13 = 0 THEN '---' WHEN i = 3 AND doc_id % 13 = 0 THEN '---' WHEN (doc_id + i) % 7 = 0 THEN '| a | ' || i || ' |' WHEN (doc_id + i) % 5 = 0 THEN '- ' || l WHEN (doc_id + i) % 23 = 0 THEN '> ' || l ELSE l END AS line
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def lines(spark, sf_dir):
    """Lines of documents with Markdown marks set on some of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "l"))
    i, k = F.col("line_index") + 1, F.col("doc_id") + F.col("line_index") + 1
    edge = F.col("doc_id") % 13 == 0
    line = (
        F.when(k % 11 == 0, F.concat(F.lit("## Part "), i)).when(k % 17 == 0, "```").when((i == 1) & edge, "---").when((i == 3) & edge, "---").when(k % 7 == 0, F.concat(F.lit("| a | "), i, F.lit(" |")))
        .when(k % 5 == 0, F.concat(F.lit("- "), "l")).when(k % 23 == 0, F.concat(F.lit("> "), "l")).otherwise(F.col("l"))
    )
    return d.select("doc_id", "line_index", line.alias("line"))


@query(f"""WITH {LINES_SQL}, h AS (SELECT *, nullif(regexp_extract(line, '^## (.*)$', 1), '') AS h FROM lines)
SELECT doc_id, line_index, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_heading FROM h""")
def heading_context(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("h", F.regexp_extract("line", "^## (.*)$", 1))
    return O.with_heading(rows, "doc_id", "line_index", "h").select("doc_id", "line_index", "current_heading")


@query(f"""WITH {LINES_SQL}, a AS (SELECT *, first_value(trim(line) = '---') OVER w AS fm, coalesce(sum(CASE WHEN trim(line) = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rules FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)),
b AS (SELECT *, fm AND rules < 2 AS front, NOT (fm AND rules < 2) AND regexp_matches(line, '^\\s*(```|~~~)') AS mark FROM a), c AS (SELECT *, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index) AS marks FROM b)
SELECT doc_id, line_index, CASE WHEN front THEN 'front-matter' WHEN mark THEN 'fence-mark' WHEN marks % 2 = 1 THEN 'fenced' ELSE 'text' END AS region FROM c""")
def fence_state(spark, sf_dir):
    return O.regions(lines(spark, sf_dir), "doc_id", "line_index", "line").select("doc_id", "line_index", "region")


def _plain(pattern: str) -> str:
    """A pattern without the flags that only Java needs."""
    return pattern.removeprefix("(?Ud)")


MARKED_SQL = """marked AS (SELECT doc_id, line_index, CASE WHEN NOT starts_with(line, '## Part') THEN line WHEN line_index % 5 = 0 THEN '   ' || line || ' ##' WHEN line_index % 5 = 1 THEN '# C#' WHEN line_index % 5 = 2 THEN '#' || line || '#'
 WHEN line_index % 5 = 3 THEN '!!! note "' || line || '"' ELSE line END AS line FROM lines)"""
MARKDOWN_SQL = f"""WITH {LINES_SQL}, {MARKED_SQL}, a AS (SELECT *, first_value(trim(line) = '---') OVER w AS fm, coalesce(sum(CASE WHEN trim(line) = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rules FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)),
b AS (SELECT *, fm AND rules < 2 AS front, NOT (fm AND rules < 2) AND regexp_matches(line, '{O.FENCE}') AS mark FROM a), c AS (SELECT *, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_index) AS marks FROM b),
h AS (SELECT doc_id, line_index, line, NOT front AND NOT mark AND marks % 2 = 0 AS plain, {strip(f"regexp_extract(line, '{_plain(O.HEADING)}', 2)")} AS heading FROM c),
r AS (SELECT *, last_value(nullif(CASE WHEN plain THEN heading ELSE '' END, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_heading FROM h),
t AS (SELECT *, {strip("line")} AS s, {strip(f"regexp_extract(line, '{_plain(O.ADMONITION)}', 2)")} AS title FROM r WHERE plain),
k AS (SELECT *, CASE WHEN regexp_matches(line, '{_plain(O.HEADING)}') THEN 'heading' WHEN title <> '' THEN 'admonition_title' WHEN contains(line, '|') THEN 'table_cell' WHEN regexp_matches(line, '{_plain(O.BLOCKQUOTE)}') THEN 'blockquote' WHEN regexp_matches(line, '{_plain(O.LIST)}') THEN 'list_item' ELSE 'paragraph' END AS kind
 FROM t WHERE NOT (s = '' OR (contains(s, '|') AND regexp_matches(line, '{O.SEPARATOR}')) OR regexp_matches(line, '{O.REFERENCE}') OR starts_with(s, '<!--') OR starts_with(s, '[//]:') OR starts_with(s, '{{:'))),
o AS (SELECT doc_id, line_index, current_heading, kind, NULL::INT AS cell_index, CASE kind WHEN 'heading' THEN heading WHEN 'admonition_title' THEN trim(title, '"') WHEN 'blockquote' THEN {strip(f"regexp_extract(line, '{_plain(O.BLOCKQUOTE)}', 2)")} WHEN 'list_item' THEN {strip(f"regexp_extract(line, '{_plain(O.LIST)}', 2)")} ELSE s END AS text,
  CASE kind WHEN 'heading' THEN length(regexp_replace(regexp_extract(line, '{_plain(O.HEADING)}', 1), '[^#]', '', 'g'))::INT END AS level FROM k WHERE kind <> 'table_cell'
 UNION ALL SELECT doc_id, line_index, current_heading, kind, cell_index, {strip("cell")} AS text, NULL AS level FROM (SELECT *, unnest(string_split(line, '|')) AS cell, unnest(range(len(string_split(line, '|'))))::INT AS cell_index FROM k WHERE kind = 'table_cell') WHERE NOT regexp_matches({strip("cell")}, '^:?-{{3,}}:?$'))
SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_index, cell_index))::INT AS id FROM o WHERE text <> ''"""


@query(MARKDOWN_SQL)
def markdown_segments(spark, sf_dir):
    """Headings with closing marks, indented ones and ones that end in a mark among the lines."""
    i, line = F.col("line_index") % 5, F.col("line")
    marked = F.when(~line.startswith("## Part"), line).when(i == 0, F.concat(F.lit("   "), "line", F.lit(" ##"))).when(i == 1, "# C#").when(i == 2, F.concat(F.lit("#"), "line", F.lit("#"))).when(i == 3, F.concat(F.lit('!!! note "'), "line", F.lit('"'))).otherwise(line)
    return O.markdown_segments(lines(spark, sf_dir).withColumn("line", marked))


@query(f"WITH {RUNS_SQL} SELECT page, ord, printf('p%04d-s%05d', page, row_number() OVER (PARTITION BY page ORDER BY top, \"left\", ord)) AS id FROM runs")
def assign_ids(spark, sf_dir):
    w = Window.partitionBy("page").orderBy("top", "left", "ord")
    return runs(spark, sf_dir).select("page", "ord", F.format_string("p%04d-s%05d", "page", F.row_number().over(w)).alias("id"))


@query(f"""WITH {RUNS_SQL}, k AS (SELECT *, floor(top / 40) AS line FROM runs), o AS (SELECT *, CASE WHEN "left" - lag("right") OVER (PARTITION BY page, line ORDER BY "left", ord) <= greatest(72.0, greatest(6.0, font) * 8) THEN 0 ELSE 1 END AS op FROM k), g AS (SELECT *, sum(op) OVER (PARTITION BY page, line ORDER BY "left", ord) AS grp FROM o)
SELECT page, line, grp AS "group", min("left") AS "left", max("right") AS "right", count(*) AS runs, string_agg(text, ' ' ORDER BY "left", ord) AS text FROM g GROUP BY page, line, grp""")
def merge_runs_gap(spark, sf_dir):
    return O.merged_runs(runs(spark, sf_dir).withColumn("line", F.floor(F.col("top") / 40).cast("double")), ["page", "line"])


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 30 AS batch FROM events")
def fixed_batches(spark, sf_dir):
    return O.fixed_batches(table(spark, sf_dir, "events"), ["event_type"], "event_id", 30).select("event_id", "batch")


@query(f"WITH {RUNS_SQL}, m AS (SELECT max(page) AS mx FROM runs), p AS (SELECT mx, greatest(1, least(CASE WHEN mx < 20 THEN 3 WHEN mx < 50 THEN 5 ELSE 10 END, 1000, mx)) AS w FROM m) SELECT DISTINCT page, (page - 1) // CAST(ceil(mx / w) AS BIGINT) AS part FROM runs, p")
def page_partitions(spark, sf_dir):
    return O.page_partitions(runs(spark, sf_dir).select("page").distinct(), 1000)


@query('SELECT user_id AS xref, event_id % 5 AS x, min(event_id) AS event_id FROM events WHERE user_id > 0 GROUP BY 1, 2')
def dedup_xref(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id > 0").select(F.col("user_id").alias("xref"), (F.col("event_id") % 5).alias("x"), "event_id")
    return O.keep_first(rows, ["xref", "x"], ["event_id"])


@query("SELECT event_id, (event_id // 5) * 5 + 1 AS chunk_start, event_id % 5 + 1 AS local, (event_id % 5 + 1) + ((event_id // 5) * 5 + 1) - 1 AS slide FROM events")
def rebase_ordinals(spark, sf_dir):
    start, local = F.floor(F.col("event_id") / 5) * 5 + 1, F.col("event_id") % 5 + 1
    return table(spark, sf_dir, "events").select("event_id", start.alias("chunk_start"), local.alias("local"), (local + start - 1).alias("slide"))


@query(f'WITH {RUNS_SQL} SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY top, "left", ord) AS rank FROM runs')
def sort_top_left(spark, sf_dir):
    return runs(spark, sf_dir).select("page", "ord", F.row_number().over(Window.partitionBy("page").orderBy("top", "left", "ord")).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_partkey AS VARCHAR), l_linenumber) AS rank FROM lineitem")
def sort_path_lexical(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_partkey").cast("string"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("rank"))


@query("SELECT p_brand, string_agg(p_name, '|' ORDER BY length(p_name) DESC, p_partkey) AS terms FROM part GROUP BY p_brand")
def terms_by_length(spark, sf_dir):
    t = F.struct((-F.length("p_name")).alias("n"), "p_partkey", "p_name")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["p_name"]), "|").alias("terms"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20")
def limit_filtered(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def latest_by_time(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query(f"WITH {RUNS_SQL} SELECT page, printf('b%05d', ord) AS id, row_number() OVER (PARTITION BY page ORDER BY printf('b%05d', ord)) AS rank FROM runs")
def sort_page_id(spark, sf_dir):
    r = runs(spark, sf_dir).select("page", F.format_string("b%05d", "ord").alias("id"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("id")))
