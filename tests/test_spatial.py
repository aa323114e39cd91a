"""Grid joins and page layout against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import layout, spatial

BOX = "page long, id long, left double, top double, right double, bottom double"


def boxes(rng, n, width, sizes):
    out = []
    for i in range(n):
        x, y = rng.uniform(-50, width), rng.uniform(-50, width)
        out.append((rng.randint(0, 2), i, x, y, x + rng.choice(sizes), y + rng.choice(sizes)))
    return out


def test_centres_in_boxes(spark):
    """Boxes of all sizes, without area, inside out, on edges and without numbers."""
    rng = random.Random(1)
    rows = boxes(rng, 300, 900, [0, 5, 20, 60]) + [(0, 900, 16.0, 16.0, 16.0, 16.0), (0, 901, None, 1.0, 2.0, 3.0), (0, 902, math.nan, 1.0, 2.0, 3.0), (None, 903, 1.0, 1.0, 2.0, 2.0)]
    held = boxes(rng, 80, 900, [0, 3, 16, 64, 100, 400, 5000]) + [(0, 800, 16.0, 16.0, 32.0, 16.0), (0, 801, 60.0, 60.0, 10.0, 10.0), (0, 802, None, 0.0, 9.0, 9.0), (0, 803, 0.0, math.nan, 9.0, 9.0), (None, 804, 0.0, 0.0, 9.0, 9.0)]
    b = spark.createDataFrame(held, BOX).withColumnRenamed("id", "table")
    found = spatial.centres_inside(spark.createDataFrame(rows, BOX), b, ["page"])
    inside = lambda r, t: None not in (*r, *t) and r[0] == t[0] and t[2] <= (r[2] + r[4]) / 2 <= t[4] and t[3] <= (r[3] + r[5]) / 2 <= t[5]
    assert sorted((r["id"], r["table"]) for r in found.collect()) == sorted((r[1], t[1]) for r in rows for t in held if inside(r, t))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert spatial.centres_inside(spark.createDataFrame(rows, BOX), b.limit(0), ["page"]).count() == 0


def test_nearest_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 3), rng.choice([rng.uniform(0, 400), 100_000.0]), rng.uniform(0, 400)) for i in range(200)] + [(500, 0, None, 1.0), (501, None, 1.0, 1.0), (502, 9, 1.0, 1.0)]
    targets = [(1000 + i, rng.randint(0, 2), float(rng.randint(0, 400)), float(rng.randint(0, 400))) for i in range(150)] + [(2000, 0, 5.0, 5.0), (1999, 0, 5.0, 5.0)]
    a = spark.createDataFrame(rows, "id long, page int, left double, top double")
    b = spark.createDataFrame(targets, "near long, page int, left double, top double")
    got = {r["id"]: (r["d"], r["near"]) for r in spatial.nearest(a, b, ["page"], "id", "near").collect()}
    want = {}
    for i, page, x, y in rows:
        if own := [(abs(x - u) + abs(y - v), n) for n, p, u, v in targets if p == page and x is not None]:
            want[i] = min(own)
    assert got == want
    assert spatial.nearest(a, b.limit(0), ["page"], "id", "near").count() == 0


@pytest.mark.parametrize("few", [0, 5, 1000])
def test_nearest_by_lists_and_by_cells(spark, monkeypatch, few):
    """Keys of few targets and of many at once; where all are few, rows are written once, however far their targets lie."""
    rng = random.Random(3)
    at = lambda: (rng.choice([rng.uniform(0, 300), 9_000.0, -7.0]), rng.uniform(-50, 300))
    rows, targets = [(i, rng.choice([0, 1, 2, 3]), *at()) for i in range(120)], [(1000 + i, rng.choice([0, 0, 0, 0, 0, 1, 2]), *map(round, at())) for i in range(60)]
    a = spark.createDataFrame(rows, "id long, page int, left double, top double")
    b = spark.createDataFrame([(n, p, float(u), float(v)) for n, p, u, v in targets], "near long, page int, left double, top double")
    written = []
    monkeypatch.setattr(spatial, "settled", lambda df, name, put=spatial.settled: (written.append(name), put(df, name))[1])
    got = {r["id"]: (r["d"], r["near"]) for r in spatial.nearest(a, b, ["page"], "id", "near", few=few).collect()}
    assert got == {i: min((abs(x - u) + abs(y - v), n) for n, p, u, v in targets if p == page) for i, page, x, y in rows if page < 3}
    assert (len(written) == 1) == (few == 1000)


def test_openings(spark):
    texts = ["", "a", "ab", "abcdefg", "xabcde", None, "bc", "cdefgh", "가나다라마바"]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    held, opened = spatial.openings(a, a.withColumnRenamed("i", "j"), 5)
    got = {(r["i"], r["j"]) for r in held.join(opened, "_gram").select("i", "j").collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s is not None and t is not None and t[:5] in s}


TEXTS = ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "xabcdefghix", "abcdefghi abcdefghij", None, "bc", "hij", "가나다라마바사아자", "다라마바사아자", "가", "aaaaaaaaaaaa", "aaaaaaaaa", "purchase 1", "purchase 2", "a purchase 1"]


def test_holding_whole_texts(spark):
    a = spark.createDataFrame([(p, i, t) for p in (0, 1, None) for i, t in enumerate(TEXTS)], "page int, i int, text string")
    b = a.where("page is null or page = 0 or i % 2 = 0").withColumnRenamed("i", "j")
    holds, own = spatial.holding(a, b, ["page"])
    got = [(r["page"], r["i"], r["j"]) for r in holds.join(own, ["page", "_gram"]).select("page", "i", "j").collect()]
    want = {(p, i, j) for p in (0, 1) for i, s in enumerate(TEXTS) for j, t in enumerate(TEXTS) if (p == 0 or j % 2 == 0) and s is not None and t is not None and t in s}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_nearest_of_texts_that_hold_each_other(spark, few):
    """By the whole of texts, of which many begin alike: in arrays, by what they hold, and one page in each way."""
    rng = random.Random(4)
    make = lambda n, at: [(at + i, rng.choice([0, 0, 0, 1, 2]), float(rng.randint(-50, 400)), float(rng.randint(0, 400)), rng.choice(TEXTS)) for i in range(n)]
    rows, targets = make(150, 0) + [(400, 0, None, 1.0, "ab"), (401, None, 1.0, 1.0, "ab"), (402, 9, 1.0, 1.0, "ab"), (403, 0, 1.0, 1.0, "abcdefgz"), (404, 5, 1.0, 1.0, "so far"), (405, 5, 1.0, 1.0, "so near")], make(90, 1000) + [(1900, 5, None, 1.0, "so far"), (1901, 5, 1.0, None, "so far and near"), (1902, 5, None, 1.0, "so near"), (1903, 5, 2.0, 1.0, "not so near")]
    a = spark.createDataFrame(rows, "id long, page int, left double, top double, text string")
    b = spark.createDataFrame(targets, "near long, page int, left double, top double, text string")
    got = {r["id"]: (r["d"], r["near"]) for r in spatial.nearest_holding(a, b, ["page"], "id", "near", few=few).collect()}
    want = {}
    for i, page, x, y, s in rows:
        if own := [(abs(x - u) + abs(y - v) if None not in (x, y, u, v) else None, n) for n, p, u, v, t in targets if p == page and None not in (s, t) and (s in t or t in s)]:
            want[i] = min(own, key=lambda m: (m[0] is None, m[0] or 0, m[1]))
    assert got == want and want[400][0] is None and want[404] == (None, 1900) and want[405] == (1.0, 1903)


def test_nearest_match_goes_by_whole_texts(spark, tmp_path):
    """Runs of one kind with other numbers begin alike, but none holds the other."""
    from segmill.plans import QUERIES

    events = [(0, 1, "purchase"), (7, 2, "purchase"), (2, 3, "purchase"), (4, 4, "error"), (11, 5, "error"), (25, 6, "terror"), (14, 7, "ter")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["ord"], r["near"]) for r in QUERIES["nearest_match"](spark, str(tmp_path)).collect()}
    assert got == {(0, 7), (4, 11)}


def test_many_texts_that_begin_alike(spark):
    """20,000 texts of a page share their opening: each meets those it holds alone."""
    rows = spark.range(20_000).select(F.lit(1).alias("page"), "id", F.concat(F.lit("run number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"))
    holds, own = spatial.holding(rows, rows.withColumnRenamed("id", "near"), ["page"])
    assert holds.count() == 20_000
    assert holds.join(own, ["page", "_gram"]).where("id = near").count() == 20_000


@pytest.mark.parametrize("width", [60, 400])
def test_page_cells_lose_nothing(spark, width):
    """Doubles and OCR lines of a page equal those of loops over all boxes."""
    rng = random.Random(width)
    words = ["alpha", "beta gamma delta", "Alpha ", "alpha beta gamma", "twelve letters", " ", "", None, "x y z w v u t s", "gamma"]
    rows = [(1, i, x := rng.uniform(-20, width), y := rng.uniform(-20, width), x + rng.choice([0.0, 20.0, 60.0, 200.0]), y + rng.choice([0.0, 5.0, 9.0, 40.0]), 9.0, rng.choice(words)) for i in range(120)]
    df = spark.createDataFrame(rows, "page long, ord long, left double, top double, right double, bottom double, font double, text string")
    text = lambda r: " ".join((r[7] or "").split()).lower()

    def shared(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        least = min((a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3]))
        return w * h / least if least > 0 else 0

    kept = []
    for r in rows:
        for k in kept:
            s, t = text(r), text(k)
            w = min(r[4] - r[2], k[4] - k[2])
            beside = w > 0 and max(0, min(r[4], k[4]) - max(r[2], k[2])) / w >= 0.25
            near = max(k[3] - r[5], r[3] - k[5], 0) <= max(42, 2.5 * (r[5] - r[3]), 2.5 * (k[5] - k[3]))
            if (s and s == t and shared(r, k) >= 0.25) or shared(r, k) >= 0.88 or (near and beside and s and t and ((s == t and len(s) >= 8) or (len(s) >= 12 and s in t) or (len(t) >= 12 and t in s))):
                break
        else:
            kept.append(r)
    assert sorted(r["ord"] for r in layout.without_duplicates(df).collect()) == [r[1] for r in kept]

    own, lines = rows[:20], rows[20:]
    known, boxed, new = {text(r) for r in own if text(r)}, list(own), []
    for r in lines:
        x, y = (r[2] + r[4]) / 2, (r[3] + r[5]) / 2
        if text(r) and not any(text(r) in k or k in text(r) for k in known) and not any(shared(r, b) >= 0.35 or (b[2] <= x <= b[4] and b[3] <= y <= b[5]) for b in boxed):
            known.add(text(r))
            boxed.append(r)
            new.append(r[1])
    assert sorted(r["ord"] for r in layout.new_ocr_lines(df.where("ord < 20"), df.where("ord >= 20")).collect()) == new

    lined, order = [], sorted((r for r in rows if text(r)), key=lambda r: (r[3], r[2], r[1]))
    want = {}
    for r in order:
        h = max(1, r[5] - r[3])
        for k, (t, b) in enumerate(lined):
            if abs(r[3] - t) <= max(2, 0.75 * min(h, max(1, b - t))):
                lined[k], want[r[1]] = (min(t, r[3]), max(b, r[5])), k
                break
        else:
            want[r[1]] = len(lined)
            lined.append((r[3], r[5]))
    assert {r["ord"]: r["line"] for r in layout.line_clusters(df).collect()} == want


def test_a_page_of_many_runs(spark):
    """100,000 runs on one page: each meets those near it alone."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("page"), F.col("id").alias("ord"), (F.col("id") % 300 * 30.0).alias("left"), (F.floor(F.col("id") / 300) * 14.0).alias("top")).withColumns({"right": F.col("left") + 25, "bottom": F.col("top") + 10, "text": F.concat(F.lit("run number "), F.lpad(F.col("ord").cast("string"), 6, "0"))})
    assert layout.without_duplicates(rows).count() == n
    tables = rows.where("ord % 50 = 3").select("page", F.col("ord").alias("table"), (F.col("left") - 40).alias("left"), (F.col("top") - 40).alias("top"), (F.col("right") + 40).alias("right"), (F.col("bottom") + 40).alias("bottom"))
    inside = spatial.centres_inside(rows, tables, ["page"])
    assert 20_000 < inside.count() < n


def test_pages_in_a_stream(spark):
    """Pages are cut by batches anywhere, one fills several, one has no number: each is worked off whole, once."""
    import pyarrow as pa

    pages = [None] * 3 + [1] * 5 + [2] + [3] * 40 + [4] * 2 + [7]
    table = pa.table({"page": pa.array(pages, pa.int64()), "x": list(range(len(pages)))})
    for size in (1, 2, 3, 7, 100):
        seen = []
        run = layout._paged("page", ["x"], lambda rows, seen=seen: seen.append([x for x, in rows]) or [float(x) for x, in rows], "y")
        out = pa.Table.from_batches(run(iter(table.to_batches(size))))
        assert out.column("y").to_pylist() == table.column("x").to_pylist() == out.column("x").to_pylist()
        assert seen == [[k for k, p in enumerate(pages) if p == own] for own in dict.fromkeys(pages)]
    assert list(layout._paged("page", ["x"], None, "y")(iter([]))) == []
