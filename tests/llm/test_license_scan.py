import re
import textwrap

import duckdb
from pyspark.sql import functions as F

from segmill.llm import license_scan
from segmill.llm.licences import LICENCES


def test_variants_of_a_licence(spark):
    mit = LICENCES["MIT"]
    variants = [mit, mit.upper(), mit.replace("Copyright (c) <year> <copyright holders>", "Copyright 2019-2021 Somebody & Others\n(c) 2022 More"), mit.replace("license", "licence").replace("sublicense", "sub-license"), mit.replace("\n", "\r\n").replace(",", " "), mit + " and one more clause"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(variants)] + [(10, "x\nreleased under the MIT Licence\ny"), (11, "© somebody"), (12, "Fixed by a lawyer.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["n_notices"], r["notices"]) for r in license_scan.scan(docs).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT"] * 5 + [None]
    assert got[10] == (None, 1, "MIT (notice)") and got[11] == got[12] == (None, 0, "")


def test_whole_texts(spark):
    """Long licences are known as whole texts, also in upper case, with other marks, or wrapped at another width."""
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GFDL-1.3"]
    wrapped = lambda t: "\n\n".join(textwrap.fill(p, 50) for p in re.split(r"\n\s*\n", t))
    rows = [(n, LICENCES[n]) for n in names] + [(n, LICENCES[n].upper().replace(",", " ;").replace("'", "")) if "'" not in LICENCES[n] else (n, LICENCES[n].upper()) for n in names]
    rows += [(n, wrapped(LICENCES[n])) for n in ("Apache-2.0", "MPL-2.0")] + [("Apache-2.0", LICENCES["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2024 Somebody"))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
    half = spark.createDataFrame([(1, LICENCES["Apache-2.0"][:5000])], "doc_id long, text string")
    assert [r["licence"] for r in license_scan.scan(half).collect()] == [None]


def test_documents_equal_sql(spark, documents, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(map(tuple, license_scan.scan(documents).collect())) == sorted(want)


def test_edges(edge):
    got = license_scan.scan(edge.withColumns({"digest": F.lit(1), "whole": F.lit(1), "row": F.lit(2)}))
    assert got.count() == edge.count() and got.where("licence is not null or n_notices > 0").count() == 0
    assert license_scan.scan(edge.limit(0)).count() == 0
