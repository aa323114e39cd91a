"""Queries on grouped pandas functions and Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import text as T
from ..operators import layout as L
from ..operators import links as K
from ..operators import masking as K2
from ..operators import provider as P
from ..operators.text_state import text_runs
from .catalog import query, table
from .join_queries import segments
from .text_queries import RUNS_SQL, runs


NORM = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
#: Rows of a page taken one after the other, with what was kept so far as lists.
STEPS_SQL = f"""o AS (SELECT *, {NORM('text')} AS t, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM runs)"""
OVERLAP_SQL = """(CASE WHEN least((a."right" - a."left") * (a.bottom - a.top), (k."right" - k."left") * (k.bottom - k.top)) > 0 THEN greatest(0, least(a."right", k."right") - greatest(a."left", k."left")) * greatest(0, least(a.bottom, k.bottom) - greatest(a.top, k.top)) / least((a."right" - a."left") * (a.bottom - a.top), (k."right" - k."left") * (k.bottom - k.top)) ELSE 0 END)"""


@query(f"""WITH RECURSIVE {RUNS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, "left", ord) AS n FROM runs WHERE {NORM('text')} <> ''),
g AS (SELECT DISTINCT page, 0::BIGINT AS n, []::DOUBLE[] AS tops, []::DOUBLE[] AS bottoms, NULL::BIGINT AS ord, NULL::BIGINT AS line FROM runs
 UNION ALL SELECT page, n, CASE WHEN k > len(tops) THEN list_append(tops, top) ELSE tops END, CASE WHEN k > len(tops) THEN list_append(bottoms, bottom) ELSE list_transform(bottoms, lambda b, i: CASE WHEN i = k THEN greatest(b, bottom) ELSE b END) END, ord, k - 1
 FROM (SELECT o.page, o.n, o.ord, o.top, o.bottom, g.tops, g.bottoms, coalesce(list_filter(range(1, len(g.tops) + 1), lambda i: abs(o.top - g.tops[i]) <= greatest(2.0, 0.75 * least(greatest(1.0, o.bottom - o.top), greatest(1.0, g.bottoms[i] - g.tops[i]))))[1], len(g.tops) + 1) AS k
  FROM g JOIN o ON o.page = g.page AND o.n = g.n + 1))
SELECT runs.*, line FROM g JOIN runs USING (page, ord)""")
def line_clusters(spark, sf_dir):
    return L.line_clusters(runs(spark, sf_dir))


@query(f"""WITH RECURSIVE {RUNS_SQL}, {STEPS_SQL},
g AS (SELECT DISTINCT page, 0::BIGINT AS n, list_filter([o], lambda k: false) AS kept FROM o WHERE n = 1
 UNION ALL SELECT a.page, a.n, CASE WHEN len(list_filter(g.kept, lambda k: (a.t <> '' AND a.t = k.t AND {OVERLAP_SQL} >= 0.25) OR {OVERLAP_SQL} >= 0.88
   OR (greatest(k.top - a.bottom, a.top - k.bottom, 0.0) <= greatest(42.0, 2.5 * (a.bottom - a.top), 2.5 * (k.bottom - k.top)) AND least(a."right" - a."left", k."right" - k."left") > 0
    AND greatest(0, least(a."right", k."right") - greatest(a."left", k."left")) / least(a."right" - a."left", k."right" - k."left") >= 0.25 AND a.t <> '' AND k.t <> ''
    AND ((a.t = k.t AND length(a.t) >= 8) OR (length(a.t) >= 12 AND contains(k.t, a.t)) OR (length(k.t) >= 12 AND contains(a.t, k.t)))))) = 0 THEN list_append(g.kept, a) ELSE g.kept END
  FROM g JOIN o a ON a.page = g.page AND a.n = g.n + 1)
SELECT k.ord AS ord, k.page AS page, k."left" AS "left", k.top AS top, k."right" AS "right", k.bottom AS bottom, k.font AS font, k.text AS text FROM (SELECT unnest(arg_max(kept, n)) AS k FROM g GROUP BY page)""")
def duplicate_layout(spark, sf_dir):
    return L.without_duplicates(runs(spark, sf_dir))


@query(f"""WITH RECURSIVE {RUNS_SQL}, o AS (SELECT *, ord % 9 = 0 AS cell, bottom - top AS h, greatest(1.0, font * 0.18) AS gap, row_number() OVER (PARTITION BY page ORDER BY top, "left", ord) AS n FROM runs),
g AS (SELECT page, n, 1 AS j, top AS y, list_filter([struct_pack(l := "left", r := "right", y := top, b := bottom)], lambda x: false) AS placed, NULL::BIGINT AS ord, NULL::DOUBLE AS new_top FROM o WHERE n = 1
 UNION ALL SELECT page, CASE WHEN over THEN n + 1 ELSE n END, CASE WHEN over THEN 1 ELSE j + 1 END, CASE WHEN over THEN next_top WHEN least(r, p.r) - greatest(l, p.l) >= 0.2 * least(r - l, p.r - p.l) AND y < p.b + gap AND y + h > p.y + gap THEN p.b + gap ELSE y END,
  CASE WHEN over AND NOT cell THEN list_append(placed, struct_pack(l := l, r := r, y := final, b := final + h)) ELSE placed END, CASE WHEN over THEN o_ord END, CASE WHEN over THEN final END
 FROM (SELECT g.page, g.n, g.j, g.y, g.placed, o.cell OR g.j > len(g.placed) AS over, g.placed[g.j] AS p, o.cell, o."left" AS l, o."right" AS r, o.gap, o.h, o.ord AS o_ord, q.top AS next_top, CASE WHEN NOT o.cell AND g.y <> o.top THEN least(g.y, greatest(0.0, 792.0 - o.h)) ELSE g.y END AS final
  FROM g JOIN o ON o.page = g.page AND o.n = g.n LEFT JOIN o q ON q.page = g.page AND q.n = g.n + 1))
SELECT runs.ord, runs.page, "left", new_top AS top, "right", new_top + bottom - runs.top AS bottom, font, text, runs.ord % 9 = 0 AS cell, new_top - runs.top AS shift FROM g JOIN runs ON runs.page = g.page AND runs.ord = g.ord""")
def resolve_overlaps(spark, sf_dir):
    return L.without_overlaps(runs(spark, sf_dir).withColumn("cell", F.col("ord") % 9 == 0))


@query(f"""WITH RECURSIVE {RUNS_SQL}, own AS (SELECT *, {NORM('text')} AS t, 0::BIGINT AS n FROM runs WHERE ord % 2 = 0), lines AS (SELECT * REPLACE (text || ' ocr' || ord AS text), {NORM("text || ' ocr' || ord")} AS t, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM runs WHERE ord % 2 = 1),
g AS (SELECT page, 0::BIGINT AS n, list(own ORDER BY ord) AS kept FROM own GROUP BY page
 UNION ALL SELECT a.page, a.n, CASE WHEN a.t <> '' AND len(list_filter(g.kept, lambda k: (k.t <> '' AND (contains(k.t, a.t) OR contains(a.t, k.t))) OR {OVERLAP_SQL} >= 0.35
   OR ((a."left" + a."right") / 2 BETWEEN k."left" AND k."right" AND (a.top + a.bottom) / 2 BETWEEN k.top AND k.bottom))) = 0 THEN list_append(g.kept, a) ELSE g.kept END
  FROM g JOIN lines a ON a.page = g.page AND a.n = g.n + 1)
SELECT k.ord AS ord, k.page AS page, k."left" AS "left", k.top AS top, k."right" AS "right", k.bottom AS bottom, k.font AS font, k.text AS text FROM (SELECT unnest(arg_max(kept, n)) AS k FROM g GROUP BY page) WHERE k.n > 0""")
def ocr_suppression(spark, sf_dir):
    r = runs(spark, sf_dir)
    return L.new_ocr_lines(r.where("ord % 2 = 0"), r.where("ord % 2 = 1").withColumn("text", F.concat("text", F.lit(" ocr"), "ord")))


@query()
def reading_order(spark, sf_dir):
    return L.reading_order(runs(spark, sf_dir).withColumn("reading_order", F.when(F.col("ord") % 3 == 0, (F.col("ord") % 7).cast("double"))))


@query("""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE source END AS job, string_split(text, chr(10)) AS t FROM documents), u AS (SELECT doc_id, job, unnest(range(len(t))) AS ord, length(unnest(t)) AS chars FROM d),
l AS (SELECT *, row_number() OVER w - 1 AS n, sum(chars) OVER (PARTITION BY job ORDER BY doc_id, ord ROWS UNBOUNDED PRECEDING) AS e FROM u WINDOW w AS (PARTITION BY job ORDER BY doc_id, ord)),
x AS (SELECT i.job, i.n, min(j.n) AS "to" FROM l i LEFT JOIN l j ON i.job = j.job AND j.n BETWEEN i.n + 1 AND i.n + 12 AND (j.n - i.n >= 12 OR j.e - (i.e - i.chars) > 1000) GROUP BY i.job, i.n),
g AS (SELECT job, 0::BIGINT AS n, 0 AS chunk FROM l WHERE n = 0 UNION ALL SELECT g.job, x."to", chunk + 1 FROM g JOIN x USING (job, n) WHERE x."to" IS NOT NULL),
s AS (SELECT g.job, g.n, chunk, coalesce(x."to", (SELECT max(n) + 1 FROM l WHERE l.job = g.job)) AS "to", coalesce((SELECT doc_id FROM l WHERE l.job = g.job AND l.n = x."to"), (SELECT max(doc_id) FROM l WHERE l.job = g.job)) AS page FROM g JOIN x USING (job, n))
SELECT l.job, doc_id, CAST(ord AS BIGINT) AS ord, CAST(chars AS BIGINT) AS chars, CAST(chunk AS BIGINT) AS chunk, page AS chunk_page FROM l JOIN s ON l.job = s.job AND l.n >= s.n AND l.n < s."to" """)
def budget_chunks(spark, sf_dir):
    """The lines of jobs: a third of all documents in one, the others by source; a document is a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "third").otherwise(F.col("source")).alias("job"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    lines = d.select("job", "doc_id", F.col("ord").cast("long").alias("ord"), F.length("line").cast("long").alias("chars"), F.struct("doc_id", "ord").alias("at"))
    return L.budget_chunks(lines, ["job"], "at", most_items=12, most_size=1000, page="doc_id").drop("at")


MARKS = " See [the page](https://example.org/a) and `code` or ${name} in {{x}} <b>now</b>."


@query()
def mask_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return K2.mask_tokens(d.select("doc_id", "ord", F.concat("line", F.lit(MARKS)).alias("text")), ["the", "und"]).drop("text")


@query(f"WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) SELECT doc_id, ord, line || '{MARKS}' AS text FROM d")
def mask_restore_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    masked = K2.mask_tokens(d.select("doc_id", "ord", F.concat("line", F.lit(MARKS)).alias("text")), ["the", "und"])
    return masked.select("doc_id", "ord", K2.restored(F.col("masked"), F.col("tokens")).alias("text"))


@query()
def wrap_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return d.select("doc_id", B.wrapped("t", F.lit(200.0), F.lit(10.0)).alias("lines"), B.fitted_size("t", F.lit(400.0), F.lit(4000.0), F.lit(7.0)).alias("size"))


@query("SELECT doc_id, trim(regexp_replace(lang || ' ' || doc_id, '\\s+', ' ', 'g')) AS text FROM documents")
def sanitize_source(spark, sf_dir):
    leak = F.concat(F.lit("{'text': '{'text': '"), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit("'}'}"))
    return table(spark, sf_dir, "documents").select("doc_id", B.sanitized(leak).alias("text"))


@query("SELECT doc_id, '제목 ' || doc_id AS title FROM documents")
def polish_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.polished_title(F.concat(F.lit("제목 "), F.col("doc_id").cast("string"), F.lit("하기."))).alias("title"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN [trim(text, chr(10)), lang] END AS parts FROM documents")
def parse_blocks(spark, sf_dir):
    """Whole texts under numbered headings: in order, out of order behind a preface, and with one missing."""
    a, b = F.concat(F.lit("=== 1 ===\n"), "text", F.lit("\n")), F.concat(F.lit("=== 2 ===\n"), "lang", F.lit("\n"))
    m = F.col("doc_id") % 3
    answer = F.when(m == 0, F.concat(a, b)).when(m == 1, F.concat(F.lit("Sure:\n"), b, a)).otherwise(a)
    return table(spark, sf_dir, "documents").select("doc_id", B.blocks(answer, F.lit(2)).alias("parts"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text AS translated FROM documents WHERE doc_id % 4 <> 3")
def parse_json_response(spark, sf_dir):
    """Whole texts in answers: fenced, amid prose, under items; a quarter of the answers holds no JSON."""
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("translated")))
    m = F.col("doc_id") % 4
    answer = F.when(m == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(m == 1, F.concat(F.lit("Here: "), one, F.lit(" done"))).when(m == 2, F.concat(F.lit('{"items": ['), one, F.lit("]}"))).otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.json_results(answer)).alias("r")).select("doc_id", "r.id", "r.translated")


@query()
def html_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(B.html_segments("html")).alias("s")).select("page_id", "s.*")


@query("SELECT page_id, 'T' || page_id AS title, url FROM pages")
def html_links(spark, sf_dir):
    page = F.concat("html", F.lit('<a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"> <b>T'), F.col("page_id").cast("string"), F.lit("</b> </a><a href='/x'>no</a>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(B.html_links(page)).alias("l")).select("page_id", "l.title", "l.url")


@query("SELECT doc_id, lang || '�' AS text FROM documents")
def cmap_decode(spark, sf_dir):
    code = F.concat(F.lit("0041"), F.lower(F.hex("lang")), F.lit("ff"))
    return table(spark, sf_dir, "documents").select("doc_id", B.decoded(code, F.concat(F.lit('{"0041": "", "'), F.hex("lang"), F.lit('": "'), "lang", F.lit('"}'))).alias("text"))


@query("SELECT event_id // 40 AS stream, row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS ord, event_type AS text, CAST(10 + (event_id // 40) % 5 AS DOUBLE) AS size, 12.0 * row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS down FROM events")
def text_state_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).alias("stream"), "event_id", "event_type")
    show = e.select("stream", (F.col("event_id") * 3 + 5).alias("ord"), F.lit("Tj").alias("op"), F.array("event_type").alias("args"))
    move = e.select("stream", (F.col("event_id") * 3 + 4).alias("ord"), F.lit("Td").alias("op"), F.array(F.lit("0"), F.lit("-12")).alias("args"))
    start = e.select("stream").distinct().select("stream", F.lit(-1).cast("long").alias("ord"), F.lit("Tf").alias("op"), F.array(F.lit("F1"), (10 + F.col("stream") % 5).cast("string")).alias("args"))
    out = text_runs(show.unionByName(move).unionByName(start))
    return out.select("stream", "ord", "text", "size", (-F.col("y")).alias("down"))


NOISE = ["m.ththth.example.net", "enre.example.org"]


@query("""WITH l AS (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS category, 'd_' || page_id % 7 AS key, regexp_replace(url, '/[0-9]+.*$', '') AS url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
own AS (SELECT * FROM l WHERE key <> 'd_3'), kept AS (SELECT DISTINCT category, key, url FROM own WHERE host NOT IN ('m.ththth.example.net', 'enre.example.org')),
c AS (SELECT category, (SELECT count(DISTINCT key) FROM own o WHERE o.category = x.category) AS diagrams, count(*) AS raw, (SELECT count(*) FROM kept k WHERE k.category = x.category) AS per_diagram, (SELECT count(DISTINCT url) FROM kept k WHERE k.category = x.category) AS unique_urls FROM own x GROUP BY category)
SELECT *, raw - per_diagram AS filtered FROM c UNION ALL SELECT NULL, sum(diagrams)::BIGINT, sum(raw)::BIGINT, sum(per_diagram)::BIGINT, (SELECT count(DISTINCT url) FROM kept), (sum(raw) - sum(per_diagram))::BIGINT FROM c""")
def link_totals(spark, sf_dir):
    """Links as found, of each diagram once, in all once, and what was filtered; the index lacks one diagram that was scraped."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("category"), F.concat(F.lit("d_"), F.col("page_id") % 7).alias("key"), F.col("page_id").alias("link_ord"), F.lit("t").alias("link_title"), F.regexp_replace("url", "/[0-9]+.*$", "").alias("link_url"))
    return K.totals(p.where("key <> 'd_3'").select("category", "key"), p, NOISE)


@query("""WITH d AS (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS category, page_id, url FROM pages), x AS (SELECT category, trim(regexp_replace('D ' || (page_id % 7), '[^a-zA-Z0-9]+', '_', 'g'), '_') AS key, url FROM d)
SELECT category, key, count(DISTINCT url) AS links, count(DISTINCT url) AS urls FROM x GROUP BY category, key
UNION ALL SELECT category, NULL, (SELECT count(*) FROM (SELECT DISTINCT key, url FROM x y WHERE y.category = x.category)), count(DISTINCT url) FROM x GROUP BY category
UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM (SELECT DISTINCT category, key, url FROM x)), count(DISTINCT url) FROM x""")
def taxonomy_flatten(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("category"), (F.col("page_id") % 7).alias("k"), "page_id", "url")
    title = F.concat(F.lit("D "), F.col("k"))
    one = p.select("category", "k", title.alias("title")).distinct()
    flat = one.where("category <> 'fr'").groupBy("category").agg(F.to_json(F.array_sort(F.collect_list(F.struct("title", F.lit("u").alias("url"))))).alias("json"))
    nested = one.where("category = 'fr'").groupBy("category").agg(F.to_json(F.map_from_arrays(F.array(F.lit("sub")), F.array(F.array_sort(F.collect_list(F.struct("title", F.lit("u").alias("url"))))))).alias("json"))
    links = p.select("category", F.concat(F.lit("D_"), F.col("k")).alias("key"), F.struct(F.lit("t").alias("title"), "url").alias("l")).groupBy("category", "key").agg(F.array_sort(F.collect_list("l")).alias("l"))
    found = links.groupBy("category").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "l")))).alias("json"))
    return K.statistics(K.joined(K.flattened(flat.unionByName(nested)), K.scraped(found), ["nowhere.example"]))


def _stub(batch):
    """A provider for tests: fails on batches with an id that ends in 7, and never has those."""
    if any(i.endswith("7") for i, _ in batch):
        raise ValueError
    return {i: f"T:{t}" for i, t in batch}


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 7 THEN text ELSE 'T:' || text END AS translated, CASE WHEN doc_id % 10 = 7 THEN 'source-copy' ELSE 'translated' END AS status FROM documents")
def provider_retry(spark, sf_dir):
    return P.translated(segments(spark, sf_dir).select("id", "source"), _stub).select("id", "translated", "status")


@query("SELECT doc_id, source AS name, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '***' END AS masked_name, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '***@***' END AS email, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'PT-***-****-****' END AS patient_id FROM documents")
def mask_nested(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    person = F.struct(F.col("source").alias("name"), F.concat("lang", F.lit("@example.org")).alias("email"), F.format_string("PT-2026-%04d", F.col("doc_id") % 10000).alias("patient_id"))
    e = d.select("doc_id", F.col("source").alias("name"), F.when(F.col("doc_id") % 4 != 0, person).alias("patient"))
    return K2.masked_event(e).select("doc_id", "name", F.col("patient.name").alias("masked_name"), "patient.email", "patient.patient_id")
