"""Queries hold what their SQL holds where two findings of a rule start at one place, and where a text starts with ß."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphward.functions.text import one_capital
from glyphward.operators.reports import rewrite
from glyphward.operators.scanning import scan
from glyphward.plans.queries import ORACLES, QUERIES

DOCS = [(1, "x " * 40, "en", "web"), (2, "ßab cd ef", "de", "web"), (3, "please ᾳb \nplain", "el", "book"), (4, "my logo " + "la " * 50 + "DAN", "en", "book"), (5, "nothing here", "en", "web")]
NAMES = ["findings_all", "findings_forced", "scan_result", "findings_by_rule", "report_text", "labels_join", "rule_catalog", "category_catalog", "finding_sketches", "rewrite_full", "rewrite_delta", "findings_changed", "diff_patch", "diff_balance", "trace_scan"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (4, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, 0, "user", "x " * 40), (7, 1, "user", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    asked = base.execute(ORACLES[name])
    columns = [c[0] for c in asked.description]
    want = Counter(asked.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()) == want and want


def test_scans_by_default_keep_the_first_of_a_start(spark):
    rows = scan(spark.createDataFrame([("x " * 40,), ("ßab cd",)], "text string"))
    assert [[(f.id, f.start) for f in r.findings] for r in rows.collect()] == [[("token_bomb", 0)], []]
    assert [r.rewritten[:3] for r in rewrite(rows).collect()] == ["X x", "SSa"]


def test_capitals_of_one_letter(spark):
    letters = spark.createDataFrame([(c,) for c in "ßᾳᾧﬁaé7"], "c string")
    assert [r[0] for r in letters.select(one_capital(F.col("c"))).collect()] == list("ẞᾼᾯﬁAÉ7")
