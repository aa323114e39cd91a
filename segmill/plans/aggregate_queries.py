"""Counts, summaries, votes and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import query, table
from .join_queries import segments, tm
from .text_queries import RUNS_SQL, runs, translatable

C, D, S = F.count_if, F.countDistinct, F.sum


@query("SELECT source AS origin, count(*) AS n FROM documents GROUP BY source")
def origin_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("origin")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS method, count(*) AS n, count(*) FILTER (value >= 10) AS ok, count(*) FILTER (NOT value >= 10) AS failed FROM events GROUP BY 1")
def encode_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), C(F.col("value") >= 10).alias("ok"), C(F.col("value") < 10).alias("failed"))


@query("""WITH l AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS category, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT category, count(*) AS links, count(DISTINCT u) AS urls FROM l GROUP BY ROLLUP (category)""")
def link_stats(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("category"), F.regexp_replace("url", "[?#].*$", "").alias("u"))
    return p.rollup("category").agg(F.count("*").alias("links"), D("u").alias("urls"))


@query("SELECT event_id // 100 AS stream, count(*) AS runs, count(*) FILTER (value < 5) AS undecoded, count(*) FILTER (value < 5) = 0 AND count(*) > 0 AS ok FROM events GROUP BY 1")
def completeness(spark, sf_dir):
    bad = C(F.col("value") < 5)
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("stream")).agg(F.count("*").alias("runs"), bad.alias("undecoded"), ((bad == 0) & (F.count("*") > 0)).alias("ok"))


@query("SELECT event_type, sum(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END, 0)) AS tokens FROM events GROUP BY 1")
def token_usage(spark, sf_dir):
    used = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(S(F.coalesce(used, F.lit(0))).alias("tokens"))


@query(f"SELECT lang, sum(len(regexp_extract_all(text, '{T.WORD.replace(chr(39), chr(39) * 2)}'))) AS words FROM documents GROUP BY lang")
def word_count_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(S(T.word_count(F.col("text"))).alias("words"))


@query("""SELECT count(*) AS runs, count(*) FILTER (l_quantity <> l_linenumber) AS changed, count(*) FILTER (l_returnflag = 'A') AS failed, CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'all encoded' ELSE 'some failed' END AS note FROM lineitem""")
def run_summary(spark, sf_dir):
    failed = C(F.col("l_returnflag") == "A")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("runs"), C(F.col("l_quantity") != F.col("l_linenumber")).alias("changed"), failed.alias("failed"), F.when(failed == 0, "all encoded").otherwise("some failed").alias("note"))


@query("SELECT user_id, max(CASE WHEN event_type = 'error' THEN value END) AS max_diff, round(avg(CASE WHEN event_type = 'error' THEN value END), 4) AS mean_diff FROM events GROUP BY 1")
def diff_max_mean(spark, sf_dir):
    v = F.when(F.col("event_type") == "error", F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(v).alias("max_diff"), F.round(F.avg(v), 4).alias("mean_diff"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus = 'F') AS fail, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS skipped FROM orders")
def batch_tally(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(C(s == "O").alias("ok"), C(s == "F").alias("fail"), C(~s.isin("O", "F")).alias("skipped"))


NOUN = "[A-Z][A-Za-z0-9]+(?:[ -][A-Z][A-Za-z0-9]+)+"


@query(f"SELECT DISTINCT unnest(regexp_extract_all(text, '{NOUN}')) AS noun FROM documents")
def proper_nouns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(NOUN), 0)).alias("noun")).distinct()


@query(f"""WITH x AS (SELECT doc_id // 10 AS file, CASE doc_id % 50 WHEN 7 THEN text || ' 한국어' WHEN 18 THEN 'かな' || text WHEN 29 THEN '漢字' ELSE text END AS t FROM documents),
v AS (SELECT file, sum(len(regexp_extract_all(t, '{T.KANA}'))) AS jp, sum(len(regexp_extract_all(t, '{T.HANGUL}'))) AS kr, sum(len(regexp_extract_all(t, '{T.HAN}'))) AS ch, sum(len(regexp_extract_all(t, '[A-Za-z]'))) AS en FROM x GROUP BY 1)
SELECT file, CASE WHEN jp > 0 THEN 'jp' WHEN kr >= greatest(ch, 1) THEN 'kr' WHEN ch > 0 THEN 'ch' WHEN en > 0 THEN 'en' ELSE 'en' END AS lang FROM v""")
def detect_language(spark, sf_dir):
    m = F.col("doc_id") % 50
    t = F.when(m == 7, F.concat("text", F.lit(" 한국어"))).when(m == 18, F.concat(F.lit("かな"), "text")).when(m == 29, "漢字").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("file")).agg(T.detected_language(t).alias("lang"))


@query(f'WITH {RUNS_SQL} SELECT page, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom FROM runs GROUP BY page')
def bbox_union(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("page").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


@query("SELECT user_id, count(*) FILTER (value > 10) >= ceil(count(*) / 2) AS bold, arg_min(props, event_id) FILTER (event_type = 'click') AS first_props FROM events GROUP BY 1")
def majority_flag(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((C(F.col("value") > 10) >= F.ceil(F.count("*") / 2)).alias("bold"), F.min_by("props", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_props"))


@query("SELECT user_id % 10 AS page, list_sort(list(DISTINCT event_id // 500)) AS streams FROM events GROUP BY 1")
def distinct_streams(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("page")).agg(F.sort_array(F.collect_set(F.floor(F.col("event_id") / 500))).alias("streams"))


@query(f'WITH {RUNS_SQL} SELECT page, min("left") AS x, round(avg(top), 4) AS y, max("right") - min("left") AS width, max(font) AS font FROM runs GROUP BY page')
def group_geometry(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("page").agg(F.min("left").alias("x"), F.round(F.avg("top"), 4).alias("y"), (F.max("right") - F.min("left")).alias("width"), F.max("font").alias("font"))


@query("SELECT event_id // 50 AS page, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def object_counts(spark, sf_dir):
    kinds = ["click", "error", "view"]
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(*(C(F.col("event_type") == k).alias(k) for k in kinds))


@query("SELECT event_id // 50 AS page, count(*) AS edits, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS fonts FROM events GROUP BY 1")
def edits_by_page(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.count("*").alias("edits"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("fonts"))


@query("""WITH j AS (SELECT o_orderkey AS job, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'R') AS fallback, count(*) FILTER (l_returnflag = 'N') AS done, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT job, CASE WHEN failed = n THEN 'failed' WHEN fallback > done THEN 'fallback' WHEN done = n THEN 'translated' ELSE 'partial' END AS classification FROM j""")
def classify_run(spark, sf_dir):
    flag = F.col("l_returnflag")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("job")).agg(C(flag == "A").alias("failed"), C(flag == "R").alias("fallback"), C(flag == "N").alias("done"), F.count("*").alias("n"))
    return j.select("job", F.when(F.col("failed") == F.col("n"), "failed").when(F.col("fallback") > F.col("done"), "fallback").when(F.col("done") == F.col("n"), "translated").otherwise("partial").alias("classification"))


GATES = [("render-diff-degraded", "review", "event_id % 4 = 0"), ("render-diff-over-warn", "review", "value > 20"), ("render-diff-over-fail", "blocked", "value > 40"), ("output-validation-not-ok", "blocked", "event_type = 'error'"), ("layout-degraded", "review", "event_id % 9 = 0"), ("layout-overflow", "review", "user_id % 10 = 1"), ("build-degraded", "review", "event_id % 31 = 0")]


@query("SELECT event_id, CASE WHEN {b} THEN 'blocked' WHEN {r} THEN 'review' ELSE 'ok' END AS status, array_to_string(list_filter([{a}], lambda x: x IS NOT NULL), ',') AS reasons FROM events".format(b=" OR ".join(f"({c})" for _, s, c in GATES if s == "blocked"), r=" OR ".join(f"({c})" for _, s, c in GATES if s == "review"), a=", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in GATES)))
def quality_gate(spark, sf_dir):
    worst = lambda level: F.expr(" OR ".join(f"({c})" for _, s, c in GATES if s == level))
    reasons = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, _, c in GATES)))
    return table(spark, sf_dir, "events").select("event_id", F.when(worst("blocked"), "blocked").when(worst("review"), "review").otherwise("ok").alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query("SELECT event_id // 50 AS page, count(*) AS blocks, count(*) FILTER (coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END, 0) < 0.6) AS warnings FROM events GROUP BY 1")
def low_confidence(spark, sf_dir):
    confidence = F.coalesce(F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 10) / 10.0), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.count("*").alias("blocks"), C(confidence < 0.6).alias("warnings"))


@query("SELECT p_brand, string_agg(p_name || ' => ' || p_type, chr(10) ORDER BY p_partkey) AS prompt FROM part GROUP BY p_brand")
def glossary_prompt(spark, sf_dir):
    line = F.struct("p_partkey", F.concat("p_name", F.lit(" => "), "p_type").alias("line"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


STEP_SQL = "steps AS (SELECT user_id AS job, event_type AS step, event_id AS seq, CASE WHEN value > 20 THEN 'failed' ELSE 'done' END AS status FROM events)"


def steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("event_id").alias("seq"), F.when(F.col("value") > 20, "failed").otherwise("done").alias("status"))


@query(f"WITH {STEP_SQL} SELECT job, step, min(seq) AS created_at, max(seq) AS updated_at, arg_max(status, seq) AS status FROM steps GROUP BY job, step")
def ledger_upsert(spark, sf_dir):
    from ..operators.ledger import upserted

    return upserted(steps(spark, sf_dir))


@query(f"WITH {STEP_SQL} SELECT job, step, 'STEP_FAILED' AS code, 'error' AS severity FROM steps WHERE status = 'failed' UNION ALL SELECT job, step, 'SIGNUP_SEEN', 'info' FROM steps WHERE step = 'signup'")
def validation_events(spark, sf_dir):
    from ..operators.ledger import events_of

    return events_of(steps(spark, sf_dir), [("status = 'failed'", "STEP_FAILED", "error"), ("step = 'signup'", "SIGNUP_SEEN", "info")]).select("job", "step", "code", "severity")


@query(f"WITH {STEP_SQL}, l AS (SELECT job, step, arg_max(status, seq) AS status FROM steps GROUP BY job, step) SELECT job, count(*) AS steps, count(*) FILTER (status = 'done') AS done FROM l GROUP BY job")
def status_listing(spark, sf_dir):
    from ..operators.ledger import upserted

    return upserted(steps(spark, sf_dir)).groupBy("job").agg(F.count("*").alias("steps"), C(F.col("status") == "done").alias("done"))


@query(f"""WITH seg AS (SELECT doc_id AS id, lang, text AS source, sha256('en' || chr(10) || 'kr' || chr(10) || text) AS key FROM documents), tm AS (SELECT DISTINCT key FROM seg WHERE id % 3 = 0)
SELECT lang, count(*) AS total, count(tm.key) AS hits, count(*) FILTER (tm.key IS NULL AND {translatable('source')}) AS sent FROM seg LEFT JOIN tm USING (key) GROUP BY lang""")
def translation_slice(spark, sf_dir):
    """The flagship: normalise, filter, key, look up, route and count by language."""
    from ..operators import memory as M

    r = M.routed(M.lookup(segments(spark, sf_dir), tm(spark, sf_dir)))
    return r.groupBy("lang").agg(F.count("*").alias("total"), F.count("target").alias("hits"), C(F.col("status") == "pending").alias("sent"))
