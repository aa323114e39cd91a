"""Each stage of the pipeline against plain Python, and the whole against the rules of its stages."""


import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from segmill.llm import suffix_dedup, templates

from .test_simhash import ids, kept_by_brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_toxic_documents_go(spark, docs):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.drop_toxic(spark, docs, sf)
    assert kept.columns == P.COLUMNS
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean, toxic = [i for i, y in marks.items() if not y], [i for i, y in marks.items() if y]
    assert len([i for i in clean if i in ids]) > 0.97 * len(clean) and len([i for i in toxic if i in ids]) < 0.3 * len(toxic)


def test_one_of_each_group_stays(spark, docs):
    got = P.drop_near_duplicates(spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got.columns == P.COLUMNS and ids(got) == kept_by_brute_force(rows)


def test_rows_with_one_id_stay(spark):
    """Rows of one id whose texts have nothing in common all stay, through every stage that filters; genuine replacement characters stay too."""
    rows = [(1, f"{w} text of row {i} that is \ufffd like no other {w * 3}", "en", "s", 1) for i, w in enumerate(("alpha", "beta", "gamma"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.drop_near_duplicates, P.drop_repeated_bytes, P.drop_benchmark):
        assert pairs(stage(spark, docs, SF)) == sorted((r[0], r[1]) for r in rows)


def test_characters_at_an_edge_go_whole(spark):
    """The last byte of the first character of row 2 belongs to a string that starts inside each é too; what is left is whole characters, and a genuine U+FFFD."""
    shared = "é" * 110
    rows = [(1, f"à\ufffd{shared}\u0169 one", "en", "s", 1), (2, f"\u0129{shared}\u0129 two", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(pairs(P.drop_repeated_bytes(spark, docs, SF)))
    assert got == {1: "à\ufffd\u0169 one", 2: "\u0129 two"}


def without_repeats(raw):
    """{key: text}, or null -> the same without repeated strings of 200 bytes, by counting all; None: nothing but white space is left."""
    raw = {i: None if t is None else t.encode() for i, t in raw.items()}
    seen = {}
    for t in raw.values():
        for k in range(len(t or b"") - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    out = {}
    for i, t in raw.items():
        cuts = [(k, k + 200) for k in range(len(t or b"") - 199) if seen[t[k : k + 200]] > 1]
        if not cuts:
            out[i] = t and t.decode()
        elif (left := suffix_dedup.without(t, cuts)[0].decode("utf-8", "ignore")).strip():
            out[i] = left
    return out


def test_repeated_bytes_go(spark, docs):
    got = dict(pairs(P.drop_repeated_bytes(spark, docs, SF)))
    assert {i: t or "" for i, t in got.items()} == {i: t or "" for i, t in without_repeats({r["doc_id"]: r["text"] for r in docs.collect()}).items()}


def test_what_is_left_of_a_text(spark):
    """A null text stays null, blank texts stay as they are, but of a text that loses bytes more than white space has to be left."""
    shared = "".join(f"word{i} " for i in range(60))
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t\n", None, None, 3), (4, f"\n{shared}\n", "en", "s", 9), (5, f"\u00a0{shared}\r\n\t", "en", "s", 9), (6, f"{shared}tail", "en", "s", 9), (None, "own words", "en", "s", 4), (8, "own words", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"null_text": F.lit(1), "kept": F.lit("x"), "n_removed": F.lit(2)})
    got = sorted((tuple(r) for r in P.drop_repeated_bytes(spark, docs, SF).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], (6, "tail", "en", "s", 4), rows[6], rows[7]], key=str)


def test_contaminated_documents_go(spark, docs):
    kept = {r["doc_id"] for r in P.drop_benchmark(spark, docs, SF).collect()}
    items = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = [r["doc_id"] for r in docs.collect() if any(f" {' '.join(w)} " in f" {' '.join(r['text'].split())} " for w in items)]
    assert whole and not kept & set(whole)
    bad = {r["doc_id"] for r in templates.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("consistent").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - bad


def test_stages_take_nulls_and_empty_tables(spark, edge):
    odd = edge.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "src").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for table in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= (100 if stage is P.pack else table.count())
            assert stage is P.pack or out.columns == P.COLUMNS


def test_whole(spark, docs):
    """The rows of run() are those of plain stages, one after the other, packed without a loss."""
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in P.drop_toxic(spark, docs, SF).collect()}
    texts = {i: texts[i] for _, i in kept_by_brute_force(sorted(texts.items()))}
    texts = without_repeats(texts)
    left = spark.createDataFrame([(i, t, rows[i]["lang"], rows[i]["source"], len(t or "")) for i, t in texts.items()], docs.schema)
    bad = {r["doc_id"] for r in templates.contaminated(left, spark.read.parquet(f"{SF}/benchmark.parquet")).where("consistent").collect()}
    texts = {i: t for i, t in texts.items() if i not in bad}
    out = P.run(spark, SF).collect()
    tokens, bins, spans = {}, {}, {}
    for r in out:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
        spans.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_tokens"]))
    assert bad and tokens == {i: len((t or "").split()) + 1 for i, t in texts.items()}
    assert all([a for a, _ in sorted(s)] == [0, *[b for _, b in sorted(s)][:-1]] for s in spans.values())
    for own in bins.values():
        at = sorted((r["bin_offset"], r["bin_offset"] + r["n_tokens"]) for r in own)
        assert at[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(at, at[1:], strict=False))
        sources = [rows[r["doc_id"]]["source"] for r in own]
        assert all(sources.count(x) <= 4 for x in sources) and len({texts[r["doc_id"]] for r in own}) == len(own)
    assert P.ORACLE_SQL is None and 4 <= len(P.STAGES) <= 5
