"""Operators that SQL can't say, against plain Python."""

import io
import json
import random
import re
import zipfile
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmill.functions import batches as B
from segmill.functions import edits, slices
from segmill.functions import text as T
from segmill.operators import glossary as glossary_rows
from segmill.operators import layout, ledger, links, masking, memory, ordering, provider, text_state
from segmill.plans import ORACLES, QUERIES
from segmill.sources import files, glossary, versioned
from segmill.streaming import events

SF = "/root/testdata/sf0.001"
slices_of = slices.slices


def boxes(spark):
    rows = [(1, 0, 10.0, 10.0, 60.0, 20.0, 9.0, "alpha beta gamma"), (1, 1, 62.0, 12.0, 90.0, 21.0, 9.0, "delta"), (1, 2, 10.0, 40.0, 80.0, 50.0, 9.0, "next line"), (1, 3, 11.0, 10.5, 61.0, 20.5, 9.0, "Alpha  beta gamma"), (2, 4, 5.0, 5.0, 50.0, 15.0, 8.0, "page two"), (2, 5, 5.0, 12.0, 50.0, 22.0, 8.0, "overlapping")]
    return spark.createDataFrame(rows, "page long, ord long, left double, top double, right double, bottom double, font double, text string")


def test_layout(spark):
    b = boxes(spark)
    lines = {r["ord"]: r["line"] for r in layout.line_clusters(b).collect()}
    assert lines[0] == lines[1] == lines[3] != lines[2] and lines[4] == 0 and lines[5] in (0, 1)
    assert {r["ord"] for r in layout.without_duplicates(b).collect()} == {0, 1, 2, 4, 5}
    moved = {r["ord"]: (r["top"], r["shift"]) for r in layout.without_overlaps(b.withColumn("cell", F.col("ord") == 3)).collect()}
    assert moved[3] == (10.5, 0.0) and moved[0] == (10.0, 0.0) and moved[5][0] > 15.0 and moved[5][1] > 0
    ocr = b.where("page = 2").selectExpr("page", "ord + 10 as ord", "left + 300 as left", "top + 300 as top", "right + 300 as right", "bottom + 300 as bottom", "font", "concat('new ', ord) as text")
    again = ocr.selectExpr("page", "ord + 10 as ord", "left", "top", "right", "bottom", "font", "text")
    assert {r["ord"] for r in layout.new_ocr_lines(b, ocr.union(again)).collect()} == {14, 15}
    ranks = [r["ord"] for r in layout.reading_order(b.where("page = 1").withColumn("reading_order", F.when(F.col("ord") == 2, 0.0))).orderBy("rank").collect()]
    assert ranks[0] == 2 and ranks[1:] == [0, 3, 1]


def chunked(rows, items, budget):
    """Rows (page, size) in order -> (chunk, page of the chunk), item by item."""
    chunks, now, total = [], [], 0
    for k, (page, size) in enumerate(rows):
        if now and (len(now) >= items or total + size > budget):
            chunks.append((now, page))
            now, total = [], 0
        now, total = [*now, k], total + size
    if now:
        chunks.append((now, rows[now[-1]][0]))
    return {k: (i, page) for i, (own, page) in enumerate(chunks) for k in own}


def test_chunks_keep_the_budget(spark):
    """Jobs of many shapes at once: empty items, items over the budget, one job with most rows, null names."""
    rng = random.Random(8)
    jobs = {None: [0] * 40, "one": [500], "large": [rng.choice([0, 1, 5, 30, 99, 100, 101, 250]) for _ in range(3000)], "zero": [0, 200, 0, 0, 200, 200, 0], "few": [5, 5, 20, 1, 1, 1, 9]}
    jobs |= {f"j{i}": [rng.randint(0, 60) for _ in range(rng.randint(1, 40))] for i in range(20)}
    rows = [(job, k, None if job == "few" and s == 20 else s, k // 7) for job, sizes in jobs.items() for k, s in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job string, ord long, chars long, page long").withColumns({"_n": F.lit(9), "chunk_of": F.lit(1)}).drop("_n")
    for items, budget in ((3, 10), (7, 100), (1, 1000), (250, 100)):
        got = {(r["job"], r["ord"]): (r["chunk"], r["chunk_page"]) for r in layout.budget_chunks(df, ["job"], most_items=items, most_size=budget, page="page").collect()}
        want = {}
        for job in jobs:
            own = sorted((r[1], r[3], r[2] or 0) for r in rows if r[0] == job)
            want |= {(job, own[k][0]): c for k, c in chunked([(p, s) for _, p, s in own], items, budget).items()}
        assert got == want
    assert layout.budget_chunks(df.limit(0), ["job"]).count() == 0


@pytest.mark.parametrize("items, budget", [(3, 10), (7, 100), (5, 1), (4, 10**9)])
def test_chunks_go_on_from_block_to_block(spark, monkeypatch, items, budget):
    """Keys of several blocks, of whole blocks only, and of a last block shorter than a chunk; as many written tables for many chunks as for few (F6)."""
    monkeypatch.setattr(layout, "BLOCK", 8, raising=False)
    monkeypatch.setattr(layout, "BLOCK_ITEMS", 2, raising=False)
    written, settle = [], layout.settled
    monkeypatch.setattr(layout, "settled", lambda df, name: written.append(name) or settle(df, name))
    rng = random.Random(items)
    held = max(8, 2 * items)
    jobs = {None: [1] * (5 * held + 1), "one": [500], "whole": [rng.randint(0, 9) for _ in range(4 * held)], "zero": [0] * (3 * held + 2), "long": [rng.choice([0, 1, 2, 3, 11, 99, 101]) for _ in range(2500)]}
    jobs |= {f"j{i}": [rng.randint(0, 60) for _ in range(held * (i % 3) + i % held + 1)] for i in range(30)}
    rows = [(job, k, None if s == 2 else s, None if k % 5 == 4 else f"p{k // 3}") for job, sizes in jobs.items() for k, s in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job string, ord long, chars long, page string")
    # blocks that lie in several batches, joins that turn out small only when they run
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "13", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        got = {(r["job"], r["ord"]): (r["chunk"], r["chunk_page"]) for r in layout.budget_chunks(df, ["job"], most_items=items, most_size=budget, page="page").collect()}
        tables = len(written)
        assert layout.budget_chunks(df.where("ord < 2"), ["job"], most_items=items, most_size=budget).count() == 2 * len(jobs) - sum(len(s) == 1 for s in jobs.values())
    finally:
        for name in conf:
            spark.conf.unset(name)
    want = {}
    for job in jobs:
        own = sorted((r[1], r[3], r[2] or 0) for r in rows if r[0] == job)
        want |= {(job, own[k][0]): c for k, c in chunked([(p, s) for _, p, s in own], items, budget).items()}
    assert got == want and tables == len(written) - tables


def test_chunks(spark):
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate([5, 5, 20, 1, 1, 1, 9])], "k string, ord long, chars long")
    assert [r["chunk"] for r in layout.budget_chunks(rows, ["k"], most_items=3, most_size=10).orderBy("ord").collect()] == [0, 0, 1, 2, 2, 2, 3]


MARKDOWN = "See ![alt](img.png), [label](http://a.b/c) and [x][ref]; <http://auto.link>, http://plain.url `code` $a+b$ {{tpl}} ${var} <b>bold</b> Azure AzureAD"


def test_masking_numbers_along_the_document(spark):
    rows = spark.createDataFrame([(1, 0, MARKDOWN), (1, 1, "more `code`"), (2, 0, "none")], "doc_id long, ord long, text string")
    out = masking.mask_tokens(rows, ["Azure"]).orderBy("doc_id", "ord")
    first, second, third = out.collect()
    assert first["masked"].startswith("See ![alt](__DOCSTR_IMAGEPATH_0001__), [label](__DOCSTR_LINKURL_0002__) and [x][__DOCSTR_REF_0003__]")
    assert first["masked"].endswith("AzureAD") and [t["kind"] for t in first["tokens"]][-1] == "term"
    assert second["tokens"][0]["id"] == f"__DOCSTR_CODE_{len(first['tokens']) + 1:04d}__" and third["masked"] == "none"
    assert all(r["text"] == r["back"] for r in out.withColumn("back", masking.restored(F.col("masked"), F.col("tokens"))).collect())


GOLDENS = {
    "![a](b.png)": [("imagepath", "b.png")], "[t](u)": [("linkurl", "u")], "[](u)": [], "![x][r]": [], "[x][r]": [("ref", "r")], "[x][]": [("ref", "")],
    "<http://a.b/c>": [("autolink", "<http://a.b/c>")], "(http://in.par)": [], "see http://a.b/c]d": [("url", "http://a.b/c")], "xhttp://no.edge": [],
    "`a` `b\nc`": [("code", "`a`")], "$x$ $a\nb$": [("math", "$x$")], "$$ab$$": [("math", "$ab$")], "{{a}} {% b %} {# c #}": [("template", "{{a}}"), ("template", "{% b %}")], "{# c }} d": [("template", "{# c }}")],
    "<% a %>": [("template", "<% a %>")], "${v} {name}": [("variable", "${v}")], "<!-- c --> <b> <i\n>": [("html_comment", "<!-- c -->"), ("html_tag", "<b>")],
    "Azure AzureAD Azure AD x": [("term", "Azure AD"), ("term", "Azure")],
}


def test_protected_pieces(spark):
    """What each rule takes, and what it leaves."""
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(GOLDENS)], "doc_id long, ord long, text string")
    got = {r["text"]: [(t["kind"], t["value"]) for t in r["tokens"]] for r in masking.mask_tokens(rows, ["Azure", "Azure AD", ""]).collect()}
    assert got == GOLDENS


def serial(texts, rules, terms):
    """Segments of one document masked one after the other, tokens numbered as they come; each term a pattern of its own."""
    n, out = 0, []
    for text in texts:
        tokens = []

        def put(kind, m):
            nonlocal n
            n += 1
            value = m["x"] if "x" in m.re.groupindex else m[0]
            name = f"__DOCSTR_{kind}_{n:04d}__"
            tokens.append((name, value, kind.lower()))
            return m[0].replace(value, name) if value == m[0] else m[0][: m.start("x") - m.start()] + name + m[0][m.end("x") - m.start() :]

        text = text or ""
        for kind, pattern in [*rules, *(("TERM", rf"(?<!\w){re.escape(t)}(?!\w)") for t in sorted(terms, key=len, reverse=True))]:
            text = re.sub(pattern, lambda m, kind=kind: put(kind, m), text)
        out.append((text, tokens))
    return out


def test_masking_equals_the_serial_rule(spark):
    """Numbers run along documents of any length, also past 9,999, through texts that hold tokens already, for lists and tables of terms."""
    rng = random.Random(3)
    parts = ["word", "`c`", "[a](b)", "$x$", "http://u.v/w", "a.b", "+b+", "c+", "Term", "long term", "__DOCSTR_CODE_0001__", "é", "(", "\n", "![i](`p`)", "${v}", " ", ", "]
    terms = ["a.b", "+b+", "c+", "Term", "long term", "long", "wor", "é", "term"]
    docs = {d: ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) or None for _ in range(60)] for d in range(6)}
    docs[6] = ["`c` " * 90] * 130
    rows = spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc_id long, ord long, text string").repartition(7)
    for known, order in ((terms, terms), (spark.createDataFrame([(t,) for t in [*terms, None, ""]], "term string"), sorted(terms))):
        got = {(r["doc_id"], r["ord"]): (r["masked"], [tuple(t) for t in r["tokens"]]) for r in masking.mask_tokens(rows, known).collect()}
        want = {(d, i): x for d, texts in docs.items() for i, x in enumerate(serial(texts, masking.MARKDOWN_RULES, order))}
        assert got == want
    assert got[6, 129][1][-1][0] == "__DOCSTR_CODE_11700__"


def test_glossaries_of_any_size(spark):
    """Terms in texts and those that results lack, in one round and in many; no join in the plan."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abä가") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [(i, "".join(rng.choice("abä가 ") for _ in range(40)), "".join(rng.choice("abä가 ") for _ in range(60)) if i % 5 else None) for i in range(120)] + [(200, None, "a"), (201, "", "a")]
    rows = spark.createDataFrame(texts, "id long, source string, result string")
    terms = spark.createDataFrame([(w,) for w in [*words, *words[:9], "", None]], "term string")
    known = {w for w in words if w}
    has = {(i, w) for i, s, _ in texts for w in known if w in (s or "")}
    lacks = {(i, w) for i, s, r in texts for w in known if w in (s or "") and w not in (r or "")}
    for part in (1 << 20, 2000):
        for found, want in ((glossary_rows.contained(rows, terms, "source", part=part), has), (glossary_rows.violations(rows, terms, part=part), lacks), (glossary_rows.violations(rows, words, part=part), lacks)):
            pairs = [(r["id"], r["term"]) for r in found.collect()]
            assert len(pairs) == len(set(pairs)) and set(pairs) == want
            assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert glossary_rows.contained(rows, terms.limit(0), "source").count() == 0 and glossary_rows.contained(rows.limit(0), terms, "source").count() == 0
    held = glossary_rows.with_terms(rows, terms, "source", "held", part=2000).collect()
    assert {(r["id"], w) for r in held for w in r["held"]} == has


def test_headings_and_other_lines(spark):
    """Line by line, what a Markdown line is."""
    cases = [
        ("# C#", ("heading", "C#", 1)), ("   ### deep ###  ", ("heading", "deep", 3)), ("    # code", ("paragraph", "# code", None)), ("#no space", ("paragraph", "#no space", None)), ("## two # marks ##", ("heading", "two # marks", 2)),
        ("####### seven", ("paragraph", "####### seven", None)), ("# ", None), ("## #", ("heading", "#", 2)), ("##  #", ("heading", "#", 2)), ("## a #", ("heading", "a", 2)), ("# tab\tinside", ("heading", "tab\tinside", 1)), ("!!! note \"Quoted\"", ("admonition_title", "Quoted", None)), ("!!! note", ("paragraph", "!!! note", None)),
        ("??? tip \"T\"", ("paragraph", "??? tip \"T\"", None)), (">!!! warning x", ("admonition_title", "x", None)), (">", ("paragraph", ">", None)), ("> q > r", ("blockquote", "q > r", None)), ("-no", ("paragraph", "-no", None)), ("+ plus", ("list_item", "plus", None)), ("12) twelve", ("list_item", "twelve", None)),
        ("||---|---||", None), ("--- | x", ("table_cell", "x", None)), ("\u3000wide\u3000", ("paragraph", "wide", None)),
    ]
    rows = spark.createDataFrame([(i, 0, x) for i, (x, _) in enumerate(cases)], "doc_id long, line_index int, line string")
    got = {r["doc_id"]: (r["kind"], r["text"], r["level"]) for r in ordering.markdown_segments(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}


def test_markdown_segments(spark):
    text = ["---", "title: x", "---", "# Head one", "para", "```", "# not a head", "```", "", "| a | b |", "|---|---|", "> quote", "- item", '!!! note "Title"', "[ref]: http://x", "<!-- c -->", "## Two", "1. last"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_index int, line string")
    got = [(r["id"], r["line_index"], r["kind"], r["text"], r["level"], r["current_heading"]) for r in ordering.markdown_segments(rows).orderBy("id").collect()]
    assert got == [
        (1, 3, "heading", "Head one", 1, None), (2, 4, "paragraph", "para", None, "Head one"), (3, 9, "table_cell", "a", None, "Head one"), (4, 9, "table_cell", "b", None, "Head one"),
        (5, 11, "blockquote", "quote", None, "Head one"), (6, 12, "list_item", "item", None, "Head one"), (7, 13, "admonition_title", "Title", None, "Head one"), (8, 16, "heading", "Two", 2, "Head one"), (9, 17, "list_item", "last", None, "Two"),
    ]


def test_markdown_prefixes(spark):
    """A task's box belongs to the list mark; an admonition may stand in a quotation."""
    text = ["- [ ] open task", "* [x] done", "1) [X] third", "- [link] stays", "> !!! warning Mind this", "> plain"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_index int, line string")
    got = [(r["kind"], r["text"]) for r in ordering.markdown_segments(rows).orderBy("id").collect()]
    assert got == [("list_item", "open task"), ("list_item", "done"), ("list_item", "third"), ("list_item", "[link] stays"), ("admonition_title", "Mind this"), ("blockquote", "plain")]


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(T.mask_pii(F.lit("a@b.c, +1 555 010 0200 PT-2026-0001"))) == "***@***, ***-****-**** PT-***-****-****"
    assert one(T.normalized(F.lit(" a \n b "))) == "a b"
    assert one(T.is_mostly_english(F.lit("plain English"))) and not one(T.is_mostly_english(F.lit("한국어 문장입니다 ok")))
    assert abs(one(T.visual_units(F.lit("가A  ."))) - (1 + 0.55 + 0.28 + 0.12 + 0.35)) < 1e-9
    assert one(T.collapse_repeated(F.lit("abcdabcd"))) == "abcd"


def test_batches(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert B.wrap("aaa bbb ccc", 30, 10) == ["aaa", "bbb", "ccc"] and B.wrap("", 30, 10) == [""] and "".join(B.wrap("x" * 50, 30, 10)) == "x" * 50
    assert one(T.polished_title(F.lit("설정하기。!"))) == "설정"
    assert one(B.blocks(F.lit("=== 1 ===\na\n=== 3 ===\nb"), F.lit(2))) is None
    segments = one(B.html_segments(F.lit("<h1>Head</h1><p>a <code>x</code> b<script>no</script></p><ul><li>item</ul><span epub:type='pagebreak'>12</span>tail")))
    assert [(s["kind"], s["text"]) for s in segments] == [("h1", "Head"), ("p", "a"), ("p", "b"), ("li", "item"), ("text", "tail")]
    got = one(B.html_links(F.lit("<a href='http://a'>one</a><a href='/rel'>two</a><a href='http://b'><a href='http://c'>in</a>x</a><a href='http://d'> </a>")))
    assert [(l["title"], l["url"]) for l in got] == [("one", "http://a"), ("in", "http://c")]


def wrapped_by_characters(text, room, size):
    """Lines by trying every end, the longest first; exact hundredths."""
    unit = lambda x: sum(33 if c.isspace() else 100 if c in "가W" and c != "W" else 58 for c in x)
    out, rest = [], text
    if not rest.strip():
        return [""]
    while rest.strip():
        ends = [m.end() for m in re.finditer(r"\S+", rest)]
        if fit := [e for e in ends if unit(rest[:e]) * size <= room * 100]:
            out.append(rest[: fit[-1]])
            rest = rest[fit[-1] :].lstrip()
        elif rest[0].isspace():
            out.append("")
            rest = rest.lstrip()
        else:
            word = re.match(r"\S+\s*", rest)[0]
            at = max(1, int(len(word) * room * 100 / max(unit(word) * size, 100)))
            out.append(word[:at].rstrip())
            rest = word[at:].lstrip() + rest[len(word) :]
    return out


def test_wrapping(spark):
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab 가 \nx\té") * rng.choice([1, 1, 2, 9]) for _ in range(rng.randint(0, 25)))
        room, size = rng.choice([3.01, 7.31, 31.07, 100.93]), rng.choice([5, 7, 10])
        assert B.wrap(text, room, size) == wrapped_by_characters(text, room, size)


def test_text_state(spark):
    ops = [("Tf", ["F1", "12"]), ("Tm", ["1", "0", "0", "1", "10", "700"]), ("Tj", ["a"]), ("q", []), ("TD", ["0", "-14"]), ("Tj", ["b"]), ("Q", []), ("TL", ["20"]), ("T*", []), ("TJ", ["c", "-120", "d"]), ('"', ["1", "2", "e"])]
    rows = spark.createDataFrame([(1, i, op, args) for i, (op, args) in enumerate(ops)], "stream long, ord long, op string, args array<string>")
    got = [(r["text"], r["x"], r["y"], r["char_space"]) for r in text_state.text_runs(rows).orderBy("ord").collect()]
    assert got == [("a", 10.0, 700.0, 0.0), ("b", 10.0, 686.0, 0.0), ("cd", 10.0, 680.0, 0.0), ("e", 10.0, 660.0, 2.0)]


def test_provider_delays_and_halving():
    assert provider.delays(1, 3) == [1, 2, 4] and provider.delays(1, 3, exponential=False) == [1, 2, 3]
    calls = []

    def flaky(batch):
        calls.append(len(batch))
        if any(i == "3" for i, _ in batch):
            raise ValueError
        return {i: t.upper() for i, t in batch}

    out = provider.halved(flaky, [(str(i), f"t{i}") for i in range(8)])
    assert out["3"] == ("t3", "source-copy") and out["4"] == ("T4", "translated") and len(out) == 8
    tries = []

    def slow(batch):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return dict(batch)

    assert provider.with_retries(slow, [0, 0])([("1", "a")]) == {"1": "a"}


def test_memory_upserts(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, None)], "key string, seq long, target string")
    assert {r["key"]: r["target"] for r in memory.upsert(rows, ["key"], "seq").collect()} == {"k": "b", "l": None}
    assert {r["key"]: r["target"] for r in memory.upsert(rows, ["key"], "seq", last_wins=False).collect()} == {"k": "a", "l": None}


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿Source_Term,target,protected\n" a, ""b"" ",x,true\n  ,y,\nc,,yes\n', encoding="utf-8")
    got = {r["term"]: (r["translation"], r["strict_protected"], r["loose_protected"], r["mode"]) for r in glossary.read_glossary(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {'a, "b"': ("x", True, True, "fixed"), "c": (None, False, True, "preserve")}
    (tmp_path / "tm.csv").write_text("one,eins\nlonely\ntwo,zwei\n")
    assert glossary.read_memory(spark, str(tmp_path / "tm.csv"), header=False).count() == 2
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    for name in ("in/ready/b.epub", "in/a.epub", "in/~$a.epub", "in/done/c.epub", "in/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in files.discovered(spark, str(tmp_path / "in"), ["epub", "mobi"]).collect()] == ["b.epub", "a.epub"]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="p"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="b"/><itemref idref="i"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>A</p>")
        z.writestr("O/b.xhtml", "<p>B</p>")
    mobi = b"\0" * 60 + b"BOOKMOBI"
    rows = spark.createDataFrame([("x/book.mobi", book.getvalue()), ("y.azw3", mobi), ("z.epub", b"plain"), ("q.bin", b"?")], "path string, content binary")
    kinds = [tuple(r["f"]) for r in rows.select(files.format_of(F.col("content"), F.col("path")).alias("f")).collect()]
    assert kinds == [("epub", "high", "extension is mobi"), ("azw3", "high", None), ("epub", "extension-only", None), ("unknown", "unknown", None)]
    assert [(r["spine"], r["href"], r["xhtml"], r["drm"]) for r in files.epub_texts(rows.limit(1)).collect()] == [(0, "O/b.xhtml", "<p>B</p>", False), (1, "O/a.xhtml", "<p>A</p>", False)]


def test_links(spark):
    index = spark.createDataFrame([("flat", json.dumps([{"title": "A b!", "url": "u"}])), ("nested", json.dumps({"s": [{"title": "C", "url": "u"}], "t": [{"title": "D", "url": "u"}]}))], "category string, json string")
    found = spark.createDataFrame([("flat", json.dumps({"A_b": [{"title": "1", "url": "http://x/1"}, {"title": "2", "url": "http://x/1"}, {"title": "n", "url": "http://noise/z"}]})), ("nested", json.dumps({"C": [{"title": "3", "url": "http://x/1"}]}))], "category string, json string")
    rows = links.joined(links.flattened(index), links.scraped(found), ["noise"])
    assert {(r["category"], r["subcategory"], r["key"], r["link_title"]) for r in rows.collect()} == {("flat", None, "A_b", "1"), ("nested", "s", "C", "3"), ("nested", "t", "D", None)}
    total = {(r["category"], r["key"]): (r["links"], r["urls"]) for r in links.statistics(rows).collect()}
    assert total[None, None] == (2, 1) and total["nested", "D"] == (0, 0)


def test_titles_lose_endings_and_marks(spark):
    texts = ["설정하기。!", "  저장 합니다 . ", "열기!.?", "가요하기하기하기하기", "끝.!", "끝!.", "하기", None, "제목", "보세요 하세요！？"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.polished_title(F.col("t")).alias("t")).collect()]
    assert got == ["설정", "저장", "열기", "가요하기", "끝", "끝", "", None, "제목", "보세요"]


def test_work_keys(spark):
    paths = ["in/My Book (2).final.pdf", "a/b", ".hidden", "x/.env", "ü.txt", "d.ir/name", "n" * 300 + ".md"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(paths)], "i int, t string").orderBy("i").select(T.work_key(F.col("t")).alias("t")).collect()]
    assert got == ["in_My_Book_2_.final", "a_b", ".hidden", "x_.env", "_", "d.ir_name", "n" * 180]


def test_numbering_of_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * F.col("id") % 10_007).alias("v"))
    got = ordering.numbered(rows, ["k"], "v", "n")
    assert got.columns == ["k", "v", "n"] and got.count() == 5000
    for key in (None, "hot"):
        part = sorted((r["n"], r["v"]) for r in got.where(F.col("k").eqNullSafe(F.lit(key))).collect())
        assert [n for n, _ in part] == list(range(len(part))) and [v for _, v in part] == sorted(v for _, v in part)
    few = spark.createDataFrame([("a", None), ("a", 1.0), ("a", None), ("b", 2.0), ("a", 1.0)], "k string, v double")
    assert sorted((r["k"], r["n"]) for r in ordering.numbered(few, ["k"], "v").collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
    assert ordering.numbered(rows.limit(0), ["k"], "v").count() == 0


def test_ranges_hold_equal_counts(spark):
    """One value far from all others, and one key with all rows: no range holds much more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        rows = spark.range(1, 100_000).select(F.lit("k").alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("k", 10**15)], "k string, v long"))
        laid = ordering.ranges(rows, ["k"], "v")
        assert max(r["count"] for r in laid.groupBy("_part").count().collect()) < 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = ordering.running_totals(rows, ["k"], "v", {"n": F.lit(1), "s": F.col("v")})
    assert got.where("v = 10").first()[2:] == (9, 45) and got.where(f"v = {10**15}").first()[2:] == (99_999, 99_999 * 100_000 // 2)


def test_reports_and_full_refresh(spark, tmp_path):
    for ids in ([(1, "a", "é"), (2, "a", None), (3, "b", "c")], [(9, "a", "new")]):
        files.refresh_segments(spark.createDataFrame(ids, "id long, job string, text string"), str(tmp_path / "segments"))
    assert sorted((r["id"], r["job"]) for r in spark.read.parquet(str(tmp_path / "segments")).collect()) == [(3, "b"), (9, "a")]
    files.report_json(spark.createDataFrame([(1, "é", None)], "id long, text string, note string"), str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert json.loads(text) == {"id": 1, "text": "é", "note": None} and text.count("\n") > 3


def test_forwarding(spark, tmp_path):
    row = {"event_id": "e1", "event_time": "2026-01-01T00:00:00Z", "source_system": "s", "patient": {"patient_id": "PT-2026-0001", "name": "A B", "email": "a@b.org", "phone": "+1 555 0100 200"}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps(row))

    def refuse(batch):
        raise ConnectionError("no such host")

    for name, send, want in (("none", None, "not configured"), ("ok", lambda b: b.write.mode("overwrite").json(str(tmp_path / "sent")), "forwarded"), ("bad", refuse, "failed: ConnectionError")):
        events.forward_stream(spark, str(tmp_path / "in"), str(tmp_path / name), str(tmp_path / f"ck-{name}"), send).awaitTermination(60)
        out = spark.read.json(str(tmp_path / name)).collect()
        assert [r["forward"] for r in out] == [want] and "a@b.org" not in str(out)
    assert spark.read.json(str(tmp_path / "sent")).count() == 1 and "a@b.org" not in str(spark.read.json(str(tmp_path / "sent")).collect())


def test_append(spark, tmp_path):
    for k in range(2):
        files.append_events(spark.createDataFrame([(f"é{k}",)], "t string"), str(tmp_path / "log"))
    assert {r["t"] for r in spark.read.json(str(tmp_path / "log")).collect()} == {"é0", "é1"}


JOBS = "classification string, job string, id long"


def published(spark, path):
    return sorted((tuple(r) for r in versioned.read(spark, path, JOBS).collect()), key=str)


def test_a_job_is_in_one_class(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    assert published(spark, path) == [] and versioned.classes(spark, path) == {}
    versioned.publish(spark.createDataFrame([("ok", "a", 1), ("ok", "b", 2), ("failed", "c", 3), (None, "d", 4)], JOBS), path)
    first = versioned.classes(spark, path)
    versioned.publish(spark.createDataFrame([("ok", "c", 5), (None, "e", 6)], JOBS), path)
    assert published(spark, path) == sorted([("ok", "a", 1), ("ok", "b", 2), ("ok", "c", 5), (None, "d", 4), (None, "e", 6)], key=str)
    assert set(versioned.classes(spark, path)) == {"ok", ""}
    second = versioned.classes(spark, path)
    versioned.publish(spark.createDataFrame([("partial", "a", 7), ("partial", "a", 8)], JOBS), path)
    third = versioned.classes(spark, path)
    # what a class neither gains nor loses isn't written
    assert third[""] == second[""] != first[""] and third["ok"] != second["ok"]
    # a run that dies before its manifest leaves the version before
    before = published(spark, path)
    monkeypatch.setattr(versioned, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        versioned.publish(spark.createDataFrame([("failed", "a", 9)], JOBS), path)
    monkeypatch.undo()
    assert published(spark, path) == before
    versioned.publish(spark.createDataFrame([("failed", "a", 9)], JOBS), path)
    assert [r for r in published(spark, path) if r[1] == "a"] == [("failed", "a", 9)]
    with pytest.raises(Exception, match="(?i)exists"):
        versioned.commit(spark, path, 0, [])


def test_broken_and_locked_books(spark, tmp_path):
    """A folder with a broken book, one without a package, one cut short and one under protection is read whole."""

    def book(**more):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfile full-path="o/p.opf"/></c>')
            z.writestr("o/p.opf", '<p xmlns="x"><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/><itemref idref="c"/><itemref idref="a"/><itemref idref="none"/></p>')
            z.writestr("o/a b.xhtml", "<p>text</p>")
            for name, data in more.items():
                z.writestr(name.replace("__", "/"), data)
        return out.getvalue()

    (tmp_path / "in/deep").mkdir(parents=True)
    whole = book()
    for name, data in (("deep/good.epub", whole), ("locked.EPUB", book(**{"META-INF__encryption.xml": "<e/>"})), ("broken.epub", b"PK no archive"), ("cut.epub", whole[: len(whole) // 2]), ("empty.epub", b""), ("~$lock.epub", b"x"), ("other.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("META-INF/container.xml", "<c/>")
    (tmp_path / "in/bare.epub").write_bytes(bare.getvalue())
    got = {r["path"].rsplit("/", 1)[-1]: (r["spine"], r["href"], r["xhtml"], r["drm"], r["error"] is not None) for r in files.books(spark, str(tmp_path / "in")).coalesce(1).collect()}
    assert got["good.epub"] == (0, "o/a b.xhtml", "<p>text</p>", False, False) and got["locked.EPUB"] == (0, "o/a b.xhtml", "<p>text</p>", True, False)
    assert {k for k, v in got.items() if v == (None, None, None, None, True)} == {"broken.epub", "cut.epub", "bare.epub"} and len(got) == 5
    assert files.epub_texts(spark.createDataFrame([("x", None)], "path string, content binary")).first()["error"] == "ValueError: no content"


def test_paths_with_quotes(spark, tmp_path):
    (tmp_path / "it's" / "ready").mkdir(parents=True)
    for name in ("b.pdf", "ready/c.pdf", "~$x.pdf"):
        (tmp_path / "it's" / name).write_bytes(b"x")
    assert [r["name"] for r in files.discovered(spark, str(tmp_path / "it's"), ["pdf"]).collect()] == ["c.pdf", "b.pdf"]
    assert files.read_json(spark, str(tmp_path / "none"), "a int").count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"event_id": "1", "patient": {"patient_id": "PT-2026-0001", "name": "N", "email": "a@b.c", "phone": "+1 555 010 0200"}}
    (tmp_path / "in/a.json").write_text(json.dumps(event) + "\n" + json.dumps({"event_id": "2"}) + "\n")
    events.mask_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r["masked"]["event_id"]: r["masked"] for r in spark.read.schema(f"masked struct<{events.SCHEMA.replace(' ', ':').replace(',:', ',')}>").json(str(tmp_path / "out")).collect()}
    assert got["1"]["patient"]["name"] == "***" and got["1"]["patient"]["patient_id"] == "PT-***-****-****" and got["2"]["patient"] is None
    (tmp_path / "tm").mkdir()
    pd.DataFrame({"key": ["a", "a", "b"], "source": ["s", "s", "t"], "target": ["x", "y", "t"], "seq": [1, 2, 3]}).to_parquet(tmp_path / "tm/1.parquet")
    stream = spark.readStream.schema("key string, source string, target string, seq long").parquet(str(tmp_path / "tm"))
    events.memory_stream(stream, str(tmp_path / "memory"), str(tmp_path / "ck2")).awaitTermination(60)
    assert [(r["key"], r["target"]) for r in events.stored_memory(spark, str(tmp_path / "memory")).collect()] == [("a", "y")]


@pytest.mark.parametrize("text", ["", "x", "가나다"])
def test_cache_keys(spark, text):
    import hashlib

    assert spark.range(1).select(T.cache_key(F.lit("en"), F.lit("kr"), F.lit(text)).alias("k")).first()["k"] == hashlib.sha256(f"en\nkr\n{text}".encode()).hexdigest()


def test_answers_in_json(spark):
    """Answers as providers give them, whole and broken."""
    cases = [
        ('```json\n[{"id": 1, "translated": "é"}]\n```', [("1", "é")]), ('Sure: {"id": "a", "translated": null} bye', [("a", None)]), ('{"items": [{"id": "x"}, 5, null, {"translated": "t"}]}', [("x", None), ("None", "t")]),
        ("", None), (None, None), ("none", None), ("5", None), ('"text"', None), ("[]", []), ('{"items": 3}', None), ('{"items": null}', None), ('[{"id": 1', None), ('[1] and {"id": "b", "translated": "u"}', []), ('text [x] {"id": "c", "translated": "v"}', [("c", "v")]),
        ('{"items": []}', []), ('[{"id": 1.5, "translated": "w"}]', [("1.5", "w")]), ("```\n{\"id\": \"d\"}\n```", [("d", None)]),
    ]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").withColumn("r", T.json_results(F.col("a")))
    assert {r["i"]: r["r"] and [tuple(x) for x in r["r"]] for r in rows.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_runs(spark):
    """Sketches of runs, merged in any order and again, stay within two percent of the distinct count."""
    runs = [spark.range(k * 7000, k * 7000 + 20_000).select((F.col("id") % 3).alias("category"), F.concat(F.lit("http://h/"), "id").alias("link_url")) for k in range(4)]
    stored = [links.sketched(r, ["category"]) for r in runs]
    whole = stored[0].unionByName(stored[1]).unionByName(stored[2]).unionByName(stored[3])
    once = links.merged_sketches(whole, ["category"])
    again = links.merged_sketches(links.merged_sketches(stored[3].unionByName(stored[0]), ["category"]).unionByName(links.merged_sketches(whole, ["category"])), ["category"])
    exact = {r["category"]: r["n"] for r in runs[0].union(runs[1]).union(runs[2]).union(runs[3]).distinct().groupBy("category").agg(F.count("*").alias("n")).collect()}
    for table in (once, again):
        for r in links.estimated(table).collect():
            assert abs(r["unique_urls"] - exact[r["category"]]) <= 0.02 * exact[r["category"]]


def test_resumed_steps(spark, tmp_path):
    """A step whose result is complete isn't built again; one that was cut off is."""
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "it's a step")
    assert not ledger.exists(spark, path)
    for _ in range(2):
        assert ledger.resumed(spark, path, build).count() == 3
    assert len(built) == 1 and ledger.exists(spark, path)
    (tmp_path / "it's a step/_SUCCESS").unlink()
    assert not ledger.exists(spark, path) and ledger.resumed(spark, path, build).count() == 3 and len(built) == 2


def test_books_are_written_and_read_again(spark, tmp_path):
    """Archives with their kind first and stored, the same bytes each time; the texts come back as they were."""
    package = '<p xmlns="x"><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><itemref idref="a"/></p>'
    rows = [(f"lib/{b}.epub", n, c.encode()) for b in ("one", "two") for n, c in (("o/a.xhtml", f"<p>{b} é</p>"), ("META-INF/container.xml", '<c xmlns="x"><rootfile full-path="o/p.opf"/></c>'), ("o/p.opf", package), ("mimetype", "application/epub+zip"))]
    entries = spark.createDataFrame([*rows, ("lib/one.epub", None, b"x"), (None, "n", b"x")], "path string, name string, content binary").repartition(3)
    books = files.zipped(entries)
    first, again = ({r["path"]: bytes(r["content"]) for r in books.collect()} for _ in range(2))
    assert first == again and set(first) == {"lib/one.epub", "lib/two.epub"}
    for raw in first.values():
        book = zipfile.ZipFile(io.BytesIO(raw))
        assert [(i.filename, i.compress_type) for i in book.infolist()][0] == ("mimetype", zipfile.ZIP_STORED) and all(i.compress_type == zipfile.ZIP_DEFLATED for i in book.infolist()[1:])
        assert raw[30:58] == b"mimetypeapplication/epub+zip"
    for _ in range(2):
        written = {r["path"]: (r["target"], r["size"]) for r in files.write_files(books, str(tmp_path / "out")).collect()}
    assert written == {p: (str(tmp_path / "out" / p), len(c)) for p, c in first.items()} and len(list((tmp_path / "out/lib").iterdir())) == 2
    texts = {r["path"].rsplit("/", 1)[-1]: (r["xhtml"], r["error"]) for r in files.books(spark, str(tmp_path / "out")).collect()}
    assert texts == {"one.epub": ("<p>one é</p>", None), "two.epub": ("<p>two é</p>", None)}
    with pytest.raises(Exception, match="below the folder"):
        files.write_files(spark.createDataFrame([("../x", b"x")], "path string, content binary"), str(tmp_path / "out")).collect()


def test_inputs_move_to_done(tmp_path):
    now = datetime(2026, 1, 2, 3, 4, 5)
    for k in range(3):
        (tmp_path / "a b.pdf").write_text(str(k))
        got = files.moved_to_done([str(tmp_path / "a b.pdf"), str(tmp_path / "gone.pdf")], now=now)
        assert got == {str(tmp_path / "a b.pdf"): str(tmp_path / "done" / ["a b.pdf", "a b_20260102030405.pdf", "a b_20260102030405_2.pdf"][k])}
    assert sorted(p.read_text() for p in (tmp_path / "done").iterdir()) == ["0", "1", "2"] and not (tmp_path / "a b.pdf").exists()


def test_edits_keep_what_is_no_text(spark):
    """Broken and unknown entities, attributes with marks, comments, empty elements; plain texts are escaped, markup isn't."""
    rows = [
        ("<p>a &am<b>x</b>tail &nbsp;</p>", [([0], "b &quo"), ([1, 0], "y"), ([9], "none"), ([1], "none")], "<p>b &quo<b>y</b>tail &nbsp;</p>", 2),
        ("<?xml version='1.0'?><p t='a>b'><br/>one<!-- c -->two</p>", [([1], "1"), ([3], "2"), ([0, 0], "none")], "<?xml version='1.0'?><p t='a>b'><br/>1<!-- c -->2</p>", 2),
        ("<p>one</p>", [([0], None)], None, 1), (None, [([0], "x")], None, 0), ("no tree & <", [([0], "x")], "no tree & <", 0),
    ]
    df = spark.createDataFrame([(i, x, e) for i, (x, e, _, _) in enumerate(rows)], "i int, x string, e array<struct<path:array<int>,text:string>>")
    got = df.select("i", edits.edited("x", "e").alias("r")).orderBy("i").collect()
    assert [(r["r"]["xhtml"], r["r"]["applied"]) for r in got] == [r[2:] for r in rows]
    assert spark.range(1).select(edits.escaped(F.lit("a&b<c>")).alias("t")).first()["t"] == "a&amp;b&lt;c&gt;"


def test_titles_cut_amid_an_entity(spark, tmp_path):
    """edit_by_path on titles that are no well-formed XML equals its SQL."""
    import duckdb

    titles = ["a &am", "b &quot; c", "d &amp; e", "", "f & g", None]
    pages = spark.createDataFrame([(i, f"http://h/{i}?a=1&b", t if t is None else f"<html><title>{t}</title></html>") for i, t in enumerate(titles)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(ORACLES["edit_by_path"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, QUERIES["edit_by_path"](spark, str(tmp_path)).select(*names).collect())) == sorted(cur.fetchall())


def test_batches_are_worked_off_in_slices(spark, monkeypatch):
    """Slices cover a batch in order, whatever its rows are, and few bytes of it are Python objects at once."""
    texts = ["x" * n for n in (0, 3, 2_000_000, 5, 700_000, 700_000)] + [None] * 9000
    columns = [pa.array(texts), pa.array([[1]] * len(texts)), pa.nulls(len(texts))]
    cut = list(slices.slices(columns))
    assert [k for at, n in cut for k in range(at, at + n)] == list(range(len(texts))) and list(slices.slices([pa.array([], pa.string())])) == []
    assert all(n == 1 or sum(len(t or "") + slices.ROW for t in texts[at : at + n]) <= slices.SLICE for at, n in cut)
    pages = [f"<p>page {i} {'word ' * 40}</p>" for i in range(9000)]
    for of, column in ((B.html_segments, pages), (B.html_links, pages), (B.blocks, pages), (B.sanitized, pages)):
        sizes = []
        monkeypatch.setattr(slices, "slices", lambda c, f=slices_of, sizes=sizes: (sizes.append(n) or (at, n) for at, n in f(c)))
        assert len(of.func(pa.array(column), *([pa.array([1] * 9000)] if of is B.blocks else []))) == 9000
        assert max(sizes) < 5000 and sum(sizes) == 9000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "id long, source string").repartition(1)
    out = provider.translated(rows, provider.copy).collect()
    assert sorted((r["id"], r["translated"], r["status"]) for r in out) == [(i, t, "translated") for i, t in enumerate(pages)]


def test_restoring_goes_over_a_text_once(spark, monkeypatch):
    """The same as replacing one token after the other, whatever texts hold; many tokens are put back without that."""
    rng = random.Random(11)
    one_by_one = masking._put_back
    monkeypatch.setattr(masking, "SHORT", 0, raising=False)
    parts = ["`a`", "[x](`b`)", "$m$", "__DOCSTR_CODE_", "__DOCSTR_", "0003", "__", "_", "__DOCSTR_CODE_0002__", " ", "word", "Azure", "{{`c`}}", "3"]
    for _ in range(3000):
        m = masking.Masked("".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(40)), "DOCSTR", rng.choice([0, 7]))
        for kind, pattern in masking.MARKDOWN_RULES:
            m.hide(kind, pattern)
        m.hide_terms(["Azure", "word"])
        tokens = [(name, value) for name, value, _ in m.tokens]
        assert masking.restore(m.text, tokens) == one_by_one(m.text, tokens)
    monkeypatch.setattr(masking, "_put_back", None)
    text = "the `code` and [the](page) " * 10_000
    m = masking.Masked(text, "DOCSTR")
    for kind, pattern in masking.MARKDOWN_RULES:
        m.hide(kind, pattern)
    m.hide_terms(["the"])
    assert len(m.tokens) == 40_000 and masking.restore(m.text, [t[:2] for t in m.tokens]) == text
    assert masking.restore(None, []) is None and masking.restore("x", None) is None


def test_one_worker_masks(spark):
    """Rules and terms of one round are one Python function of a plan, not three."""
    rows = spark.createDataFrame([(1, 0, "`a` Azure")], "doc_id long, ord long, text string")
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(masking, "settled", lambda df, name: made.append(df) or df)
        masking.mask_tokens(rows, ["Azure"])
    assert str(made[0]._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1


def test_letters_are_counted_without_taking_them_out(spark):
    """As many as single matches would be; a text to be retried makes no string for each letter."""
    texts = ["", "abc", "a1b 2c\n", "가나 a다", "...", None, "😀a😀", "Zz" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.letters(F.col("t"), "[^A-Za-z]").alias("a"), T.count(F.col("t"), "[A-Za-z]").alias("b"), T.letters(F.col("t"), T.HANGUL.replace("[", "[^")).alias("c"), T.count(F.col("t"), T.HANGUL).alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows.collect())
    plan = spark.createDataFrame([("a", "b")], "s string, t string").select(T.needs_retry(F.col("s"), F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[A-Za-z], 0" not in plan
