"""Scalar functions and predicates over documents, events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators.ordering import skip_line
from .catalog import query, table

# ---- the same building blocks in DuckDB SQL
def n(x: str) -> str:
    return f"trim(regexp_replace({x}, '{T.WS}+', ' ', 'g'))"


def cnt(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def wcount(x: str) -> str:
    return f"(CASE WHEN {n(x)} = '' THEN 0 ELSE len(string_split({n(x)}, ' ')) END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def translatable(x: str) -> str:
    return f"(length({n(x)}) >= 3 AND {cnt(n(x), '[A-Za-z]')} >= 2 AND NOT (regexp_full_match({n(x)}, '[A-Z0-9_#./:,() -]+') AND {wcount(x)} <= 3))"


#: Texts of many kinds: whole documents, codes, addresses, blanks and short phrases.
PIECES_SQL = """pieces AS (
  SELECT doc_id * 8 + k AS id, CASE k
    WHEN 0 THEN text WHEN 1 THEN upper(substr(lang, 1, 2)) || '-' || doc_id WHEN 2 THEN '' WHEN 3 THEN CAST(doc_id AS VARCHAR)
    WHEN 4 THEN 'https://example.org/' || doc_id WHEN 5 THEN lang || CAST(doc_id AS VARCHAR) || '@example.org' WHEN 6 THEN lang || ' ' || source ELSE '  ' || text || chr(160) END AS t
  FROM documents, (SELECT unnest(range(8)) AS k))"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    kinds = [F.col("text"), F.concat(F.upper(F.substring("lang", 1, 2)), F.lit("-"), "doc_id"), F.lit(""), F.col("doc_id").cast("string"), F.concat(F.lit("https://example.org/"), "doc_id"), F.concat("lang", F.col("doc_id").cast("string"), F.lit("@example.org")), F.concat_ws(" ", "lang", "source"), F.concat(F.lit("  "), "text", F.lit("\u00a0"))]
    return d.select("doc_id", F.posexplode(F.array(*kinds)).alias("k", "t")).select((F.col("doc_id") * 8 + F.col("k")).alias("id"), "t")


def _flag(name: str, column, sql: str):
    """A predicate over pieces, as a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pieces(spark, sf_dir).select("id", column(F.col("t")).alias("flag"))

    run.__name__ = name
    query(f"WITH {PIECES_SQL} SELECT id, {sql} AS flag FROM pieces")(run)


ADDRESS = "[^ @]+@[^ @]+\\.[^ @]+"
_flag("filter_translatable", T.is_translatable, translatable("t"))
_flag("filter_translatable_v8", T.is_translatable_strict, f"({n('t')} <> '' AND NOT regexp_full_match({n('t')}, '[^\\p{{L}}]+') AND NOT regexp_full_match({n('t')}, '(https?://|www\\.)[^ ]+') AND NOT regexp_full_match({n('t')}, '{ADDRESS}') AND regexp_matches({n('t')}, '\\p{{L}}'))")
_flag("filter_translatable_book", T.is_translatable_book, f"(regexp_matches({n('t')}, '[A-Za-z\\x{{c0}}-\\x{{24f}}\\x{{370}}-\\x{{3ff}}\\x{{400}}-\\x{{4ff}}\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]') AND NOT regexp_full_match({n('t')}, '(?i)https?://[^ ]+') AND NOT regexp_full_match({n('t')}, '{ADDRESS}'))")
_flag("filter_skippable", T.is_skippable, f"({n('t')} = '' OR regexp_full_match({n('t')}, '[0-9]+') OR regexp_matches({n('t')}, '(?i)^https?://') OR regexp_full_match({n('t')}, '{ADDRESS}'))")
_flag("has_letter_or_number", lambda c: T.normalized(c).rlike(r"[\p{L}\p{N}]"), f"regexp_matches({n('t')}, '[\\p{{L}}\\p{{N}}]')")
_flag("unusable_text", T.is_unusable, f"(length(regexp_replace(t, '{T.WS}', '', 'g')) = 0 OR ({cnt('t', chr(92) + 'x{fffd}')} / greatest(length(regexp_replace(t, '{T.WS}', '', 'g')), 1) >= 0.35 AND NOT regexp_matches(t, '[A-Za-z]{{2}}')))")
_flag("classify_sentence", T.looks_like_sentence, "({s} <> '' AND (regexp_matches({s}, '[.,;:!?。，；：！？]') OR {w} >= 6 OR length({s}) >= 40 OR ({w} >= 4 AND regexp_matches({s}, '{h}'))))".format(s=strip("t"), w=wcount("t"), h=T.HINT.replace("'", "''")))
_flag("mostly_english", T.is_mostly_english, "(length({s}) >= 3 AND regexp_matches({s}, '[A-Za-z]{{3}}') AND {h} < {l} AND {l} / greatest(length({s}), 1) >= 0.3)".format(s=strip("t"), h=cnt(strip("t"), T.HANGUL), l=cnt(strip("t"), "[A-Za-z]")))
_flag("corruption_detect", lambda c: F.concat(F.lit("{'text': '"), c).rlike(r"\{['\"]text['\"]") & (F.length(c) > 0), "(regexp_matches('{''text'': ''' || t, '\\{[''\"]text[''\"]') AND length(t) > 0)")
_flag("skip_markdown_line", skip_line, "({s} = '' OR (contains({s}, '|') AND regexp_matches(t, '^\\s*\\|?\\s*:?-{{3,}}:?\\s*(\\|\\s*:?-{{3,}}:?\\s*)*\\|?\\s*$')) OR regexp_matches(t, '^\\s{{0,3}}\\[[^\\]]+\\]:\\s+') OR starts_with({s}, '<!--') OR starts_with({s}, '[//]:') OR starts_with({s}, '{{:'))".format(s=strip("t")))


@query(f"""WITH {PIECES_SQL}, pairs AS (SELECT id, t AS s, CASE id % 4 WHEN 0 THEN t WHEN 1 THEN '' WHEN 2 THEN '한국어 ' || t ELSE upper(t) END AS g FROM pieces)
SELECT id, {translatable('s')} AND ({n('g')} = '' OR {n('s')} = {n('g')} OR
 ({cnt(n('g'), '[A-Za-z]')} >= 40 AND {cnt(n('g'), '[A-Za-z]')} > greatest(20.0, {cnt(n('g'), T.HANGUL)} * 0.8)) OR
 ({cnt(n('g'), '[A-Za-z]')} >= 25 AND len(list_filter(list_slice(regexp_extract_all(lower({n('s')}), '[a-z]{{4,}}'), 1, 80), lambda w: contains(lower({n('g')}), w))) >= 6)) AS flag FROM pairs""")
def needs_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("id"), F.col("t")
    target = F.when(i % 4 == 0, t).when(i % 4 == 1, "").when(i % 4 == 2, F.concat(F.lit("한국어 "), t)).otherwise(F.upper(t))
    return pieces(spark, sf_dir).select("id", T.needs_retry(t, target).alias("flag"))


@query(f"SELECT doc_id, {n('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("normalized"))


DOUBLED = """doubled AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || text WHEN 1 THEN trim(text) || ' ' || trim(text) WHEN 2 THEN substr(lang || doc_id || 'abcd', 1, 6) || substr(lang || doc_id || 'abcd', 1, 6) ELSE text END AS t FROM documents)"""


@query(f"""WITH {DOUBLED}, parts AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '{T.WS}+$', '')), lambda x: x <> '') AS lines, {n('t')} AS c,
 CASE WHEN {n('t')} = '' THEN [] ELSE string_split({n('t')}, ' ') END AS w FROM doubled)
SELECT doc_id, CASE WHEN len(lines) >= 2 AND len(lines) % 2 = 0 AND lines[1:len(lines)//2] = lines[len(lines)//2+1:] THEN array_to_string(lines[1:len(lines)//2], chr(10))
 WHEN len(w) >= 4 AND len(w) % 2 = 0 AND w[1:len(w)//2] = w[len(w)//2+1:] THEN array_to_string(w[1:len(w)//2], ' ')
 WHEN length(c) >= 8 AND length(c) % 2 = 0 AND left(c, length(c)//2) = substr(c, length(c)//2 + 1) THEN left(c, length(c)//2) ELSE t END AS collapsed FROM parts""")
def collapse_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("text")
    code = F.substring(F.concat("lang", F.col("doc_id").cast("string"), F.lit("abcd")), 1, 6)
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.concat(whole, F.lit("\n"), whole)).when(m == 1, F.concat_ws(" ", F.btrim(whole), F.btrim(whole))).when(m == 2, F.concat(code, code)).otherwise(whole)
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", T.collapse_repeated(F.col("t")).alias("collapsed"))


@query(f"""WITH p AS (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN '• ' WHEN 1 THEN '(' || (doc_id % 9) || ') ' ELSE '' END) || text AS s, (CASE doc_id % 2 WHEN 0 THEN '- ' ELSE '' END) || text AS g FROM documents),
x AS (SELECT doc_id, s, g, regexp_extract(s, '{T.MARKER}', 0) AS sp, regexp_extract(g, '{T.MARKER}', 0) AS gp, ltrim(regexp_replace(g, '{T.MARKER}', ''), ' ') AS body FROM p)
SELECT doc_id, CASE WHEN sp <> '' THEN sp || body WHEN gp <> '' THEN body ELSE g END AS aligned FROM x""")
def align_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    source = F.concat(F.when(i % 3 == 0, "• ").when(i % 3 == 1, F.concat(F.lit("("), i % 9, F.lit(") "))).otherwise(""), "text")
    target = F.concat(F.when(i % 2 == 0, "- ").otherwise(""), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.align_marker(source, target).alias("aligned"))


@query("""WITH p AS (SELECT doc_id, substr(text, 1, 1 + doc_id % 30) AS a, substr(text, 2 + doc_id % 30) AS b FROM documents)
SELECT doc_id, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN contains(',.;:%)]}', left(b, 1)) OR contains('([{/#$', right(a, 1)) OR regexp_matches(right(a, 1), '""" + T.WS + """') OR regexp_matches(left(b, 1), '""" + T.WS + """') THEN a || b ELSE a || ' ' || b END AS joined FROM p""")
def join_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    a, b = F.col("text").substr(F.lit(1), (1 + i % 30).cast("int")), F.col("text").substr((2 + i % 30).cast("int"), F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.join_fragments(a, b).alias("joined"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{ws}')) AS s, len(regexp_extract_all(text, '{ws}+')) AS r, len(regexp_extract_all(text, '[0-9A-Za-z]')) AS a, len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')) AS p, length(text) AS l FROM documents)
SELECT doc_id, round(r * 0.28 + (s - r) * 0.12 + a * 0.55 + p * 0.35 + (l - s - a - p) * 0.8, 4) AS units FROM c""".format(ws=T.WS))
def visual_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.visual_units(F.col("text")), 4).alias("units"))


@query("""SELECT p_partkey, trim(regexp_replace(p_name || '--' || p_type, '[^a-zA-Z0-9]+', '_', 'g'), '_') AS key,
 left(trim(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_brand), '[\\\\/:*?"<>|\\s]+', '-', 'g'), '-+', '-', 'g'), '-'), 96) AS stem,
 left(regexp_replace(regexp_replace('in/' || p_name || '/' || p_type || '.v' || p_partkey || '.pdf', '([^/])\\.[^./]+$', '\\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), 180) AS work FROM part""")
def slug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug_key(F.concat("p_name", F.lit("--"), "p_type")).alias("key"), T.safe_stem(F.concat("p_name", F.lit(" / "), "p_brand")).alias("stem"), T.work_key(F.concat(F.lit("in/"), "p_name", F.lit("/"), "p_type", F.lit(".v"), "p_partkey", F.lit(".pdf"))).alias("work"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '^https?://([^/]+)', 1)) NOT IN ('ththre.example.com', 'm.ththth.example.net')")
def link_filter_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(~T.url_host(F.col("url")).isin("ththre.example.com", "m.ththth.example.net")).select("page_id", "url")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' PT-2026-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), '{T.EMAIL}', '***@***', 'g'), '{T.PHONE}', '***-****-****', 'g'), '{T.PATIENT}', 'PT-****-****', 'g') AS masked FROM documents")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" PT-2026-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_pii(t).alias("masked"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.WORD.replace(chr(39), chr(39) * 2)}')) AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("""SELECT doc_id, replace(replace(replace(regexp_replace(text || chr(8203) || 'ﬁ' || chr(160) || '¶', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{200b}-\\x{200d}\\x{feff}]', '', 'g'), chr(160), ' '), 'ﬁ', 'fi'), '¶', '’') AS cleaned FROM documents""")
def clean_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_chars(F.concat("text", F.lit("\u200bﬁ\u00a0¶"))).alias("cleaned"))


@query("SELECT doc_id, sha256('en' || chr(10) || 'kr' || chr(10) || text) AS line_key, sha256(lang || chr(0) || 'kr' || chr(0) || text) AS null_key, sha256(text) AS plain_key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.lit("en"), F.lit("kr"), t).alias("line_key"), T.cache_key(F.col("lang"), F.lit("kr"), t, "\0").alias("null_key"), F.sha2("text", 256).alias("plain_key"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Korean ' WHEN 1 THEN 'JA' WHEN 2 THEN 'zh' WHEN 3 THEN lang ELSE 'xx' END AS l FROM documents)
SELECT doc_id, CASE lower(trim(l)) WHEN 'ko' THEN 'kr' WHEN 'korean' THEN 'kr' WHEN 'ja' THEN 'jp' WHEN 'japanese' THEN 'jp' WHEN 'zh' THEN 'ch' WHEN 'chinese' THEN 'ch' WHEN 'english' THEN 'en' ELSE lower(trim(l)) END AS lang FROM x""")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    c = F.when(i == 0, " Korean ").when(i == 1, "JA").when(i == 2, "zh").when(i == 3, F.col("lang")).otherwise("xx")
    return table(spark, sf_dir, "documents").select("doc_id", T.lang_normalized(c).alias("lang"))


@query("SELECT event_id, regexp_extract(CASE event_id % 3 WHEN 0 THEN upper(event_type) || '_X: ' || props WHEN 1 THEN event_type || ': no' ELSE 'NO CODE' END, '^([A-Z_]+):', 1) AS code FROM events")
def issue_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 3
    m = F.when(i == 0, F.concat(F.upper("event_type"), F.lit("_X: "), "props")).when(i == 1, F.concat("event_type", F.lit(": no"))).otherwise("NO CODE")
    return table(spark, sf_dir, "events").select("event_id", T.issue_code(m).alias("code"))


@query(f"""WITH p AS (SELECT doc_id, '__DOCSTR_URL_' || lpad(CAST(doc_id % 7 AS VARCHAR), 4, '0') || '__ a __DOCSTR_TERM_0001__' AS a, '__DOCSTR_TERM_0001__ b __DOCSTR_URL_' || lpad(CAST(doc_id % 5 AS VARCHAR), 4, '0') || '__' AS b FROM documents)
SELECT doc_id, list_sort(regexp_extract_all(a, '__DOCSTR_[A-Z]+_[0-9]{{4}}__')) = list_sort(regexp_extract_all(b, '__DOCSTR_[A-Z]+_[0-9]{{4}}__')) AS equal FROM p""")
def placeholder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda k: F.concat(F.lit("__DOCSTR_URL_"), F.lpad((F.col("doc_id") % k).cast("string"), 4, "0"), F.lit("__"))
    found = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit("__DOCSTR_[A-Z]+_[0-9]{4}__"), 0))
    a, b = F.concat(token(7), F.lit(" a __DOCSTR_TERM_0001__")), F.concat(F.lit("__DOCSTR_TERM_0001__ b "), token(5))
    return table(spark, sf_dir, "documents").select("doc_id", (found(a) == found(b)).alias("equal"))


@query("SELECT doc_id, to_base64(encode(text)) AS coded, sha256(text) AS digest, true AS ok FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("coded"), F.sha2("text", 256).alias("digest"))
    return d.select("doc_id", F.regexp_replace("coded", "[\r\n]", "").alias("coded"), "digest", (F.sha2(F.unbase64("coded"), 256) == F.col("digest")).alias("ok"))


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN '100.0%' ELSE printf('%.1f%%', 100.0 * (n_chars % 7 - 1) / (n_chars % 7)) END AS share FROM documents")
def percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("n_chars") % 7
    return table(spark, sf_dir, "documents").select("doc_id", F.when(total == 0, "100.0%").otherwise(F.format_string("%.1f%%", 100.0 * (total - 1) / total)).alias("share"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_ms(ts + INTERVAL 90 SECOND) - epoch_ms(ts) AS duration_ms FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.unix_millis(ts + F.expr("INTERVAL 90 SECOND")) - F.unix_millis(ts)).alias("duration_ms"))


# ---- geometry, over boxes made of events
RUNS_SQL = """runs AS (SELECT event_id AS ord, event_id // 50 + 1 AS page, CAST((event_id * 37) % 500 AS DOUBLE) AS "left", CAST((user_id * 13) % 700 AS DOUBLE) AS top,
  CAST((event_id * 37) % 500 + 20 + event_id % 60 AS DOUBLE) AS "right", CAST((user_id * 13) % 700 + 8 + event_id % 9 AS DOUBLE) AS bottom, CAST(6 + event_id % 12 AS DOUBLE) AS font, event_type || ' ' || (event_id % 7) AS text FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    d = lambda c: c.cast("double")
    left, top = (e * 37) % 500, (u * 13) % 700
    return table(spark, sf_dir, "events").select(e.alias("ord"), (F.floor(e / 50) + 1).alias("page"), d(left).alias("left"), d(top).alias("top"), d(left + 20 + e % 60).alias("right"), d(top + 8 + e % 9).alias("bottom"), d(6 + e % 12).alias("font"), F.concat("event_type", F.lit(" "), e % 7).alias("text"))


@query(f"""WITH {RUNS_SQL}, p AS (SELECT a.page, a.ord AS a, b.ord AS b, a."left" al, a.top atop, a."right" ar, a.bottom ab, b."left" bl, b.top bt, b."right" br, b.bottom bb FROM runs a JOIN runs b ON a.page = b.page AND b.ord BETWEEN a.ord + 1 AND a.ord + 3),
m AS (SELECT *, greatest(0, least(ar, br) - greatest(al, bl)) AS w, greatest(0, least(ab, bb) - greatest(atop, bt)) AS h, least((ar - al) * (ab - atop), (br - bl) * (bb - bt)) AS s, least(ar - al, br - bl) AS mw FROM p)
SELECT a, b, round(CASE WHEN s > 0 THEN w * h / s ELSE 0 END, 6) AS overlap, ((al + ar) / 2 BETWEEN bl AND br AND (atop + ab) / 2 BETWEEN bt AND bb) AS inside, round(CASE WHEN mw > 0 THEN w / mw ELSE 0 END, 6) AS horizontal,
 CASE WHEN ab < bt THEN bt - ab WHEN bb < atop THEN atop - bb ELSE 0.0 END AS gap FROM m""")
def bbox_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    a, b = r.alias("a"), r.alias("b")
    p = a.join(b, (F.col("a.page") == F.col("b.page")) & F.col("b.ord").between(F.col("a.ord") + 1, F.col("a.ord") + 3))
    x, y = G.box("a."), G.box("b.")
    return p.select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), F.round(G.overlap_ratio(x, y), 6).alias("overlap"), G.center_inside(x, y).alias("inside"), F.round(G.horizontal_overlap(x, y), 6).alias("horizontal"), G.vertical_gap(x, y).alias("gap"))


@query(f"""WITH {RUNS_SQL} SELECT ord, greatest(0.0, least("left", 480.0)) AS "left", greatest(0.0, least(top, 600.0)) AS top, least("right", 500.0) AS "right", least(bottom, 640.0) AS bottom FROM runs""")
def clamp_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name, most: F.greatest(F.lit(0.0), F.least(F.col(name), F.lit(float(most)))).alias(name)
    return runs(spark, sf_dir).select("ord", c("left", 480), c("top", 600), F.least("right", F.lit(500.0)).alias("right"), F.least("bottom", F.lit(640.0)).alias("bottom"))


@query("""WITH c AS (SELECT event_id, CAST((event_id * 7919) % 16777216 AS INTEGER) AS c FROM events), r AS (SELECT event_id, (c >> 16) & 255 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM c)
SELECT event_id, r, g, b, round(0.2126 * r / 255 + 0.7152 * g / 255 + 0.0722 * b / 255, 6) AS luminance, round(0.2126 * r / 255 + 0.7152 * g / 255 + 0.0722 * b / 255, 6) < 0.32 AS light_text FROM r""")
def rgb_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ((F.col("event_id") * 7919) % 16777216).cast("int")
    lum = F.round(G.luminance(c), 6)
    parts = [F.round(x * 255).cast("int").alias(k) for x, k in zip(G.rgb(c), "rgb", strict=True)]
    return table(spark, sf_dir, "events").select("event_id", *parts, lum.alias("luminance"), (lum < 0.32).alias("light_text"))


@query("""WITH d AS (SELECT event_id, degrees(atan2(sin(radians(event_id % 360)), cos(radians(event_id % 360)))) AS a FROM events), m AS (SELECT event_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS d FROM d)
SELECT event_id, CASE WHEN abs(d) <= 2.0001 OR abs(d - 360) <= 2.0001 THEN 0.0 WHEN abs(d - 90) <= 2.0001 THEN 90.0 WHEN abs(d - 180) <= 2.0001 THEN 180.0 WHEN abs(d - 270) <= 2.0001 THEN 270.0 ELSE round(d, 4) END AS rotation FROM m""")
def snap_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.radians((F.col("event_id") % 360).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", G.snapped_rotation(F.cos(a), F.sin(a), 2.0001).alias("rotation"))


@query("SELECT event_id, round(greatest((value + (event_id % 5) * 0.25) * 0.9, 1.0), 6) AS layout_limit FROM events")
def layout_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(G.layout_limit(F.col("value"), F.col("event_id") % 5), 6).alias("layout_limit"))


@query("""WITH x AS (SELECT event_id, 0.8 + (event_id % 30) / 10.0 AS ratio, CAST(8 + event_id % 40 AS DOUBLE) AS size FROM events), y AS (SELECT *, greatest(size / ratio, size * 0.85, 10.0) AS new FROM x)
SELECT event_id, round(CASE WHEN ratio > 1.3 AND size - new >= 0.5 THEN new ELSE size END, 6) AS size FROM y""")
def shrink_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(G.shrunk_size(0.8 + (e % 30) / 10.0, (8 + e % 40).cast("double")), 6).alias("size"))


@query("SELECT event_id, (event_id & 16) <> 0 OR contains(lower(event_type), 'sign') AS bold, (event_id & 2) <> 0 AS italic, (event_id & 4) <> 0 AS serif, (event_id & 8) <> 0 AS mono FROM events")
def style_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda b: F.col("event_id").bitwiseAND(F.lit(b)) != 0
    return table(spark, sf_dir, "events").select("event_id", (bit(16) | F.contains(F.lower("event_type"), F.lit("sign"))).alias("bold"), bit(2).alias("italic"), bit(4).alias("serif"), bit(8).alias("mono"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'subTitle' ELSE NULL END AS ph, CASE event_id % 7 WHEN 2 THEN 'Title 1' WHEN 3 THEN 'Subtitle 2' ELSE 'Box' END AS shape, event_id % 40 AS size, (event_id % 10) / 10.0 AS y FROM events)
SELECT event_id, CASE WHEN ph = 'title' THEN 'title' WHEN ph = 'subTitle' THEN 'subtitle' WHEN contains(lower(shape), 'subtitle') THEN 'subtitle' WHEN contains(lower(shape), 'title') THEN 'title' WHEN size >= 28 AND y < 1/3.0 THEN 'title' WHEN size >= 20 THEN 'subtitle' ELSE 'body' END AS role FROM s""")
def title_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ph = F.when(e % 5 == 0, "title").when(e % 5 == 1, "subTitle")
    shape = F.lower(F.when(e % 7 == 2, "Title 1").when(e % 7 == 3, "Subtitle 2").otherwise("Box"))
    role = F.when(ph == "title", "title").when(ph == "subTitle", "subtitle").when(F.contains(shape, F.lit("subtitle")), "subtitle").when(F.contains(shape, F.lit("title")), "title")
    return table(spark, sf_dir, "events").select("event_id", role.when((e % 40 >= 28) & ((e % 10) / 10.0 < 1 / 3.0), "title").when(e % 40 >= 20, "subtitle").otherwise("body").alias("role"))
