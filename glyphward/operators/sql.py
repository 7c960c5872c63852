"""Rules and detectors as table functions of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphward.operators.rules import PythonDetector

PLACES = "nth int, start int, end int, excerpt string"


def register_detector(spark: SparkSession, name: str, detect: PythonDetector) -> None:
    """Make ``detect`` (text -> list of (start, end, excerpt)) a table function of SQL: ``FROM docs, LATERAL name(docs.text)``. Null texts give no rows. Rows go to Python and back in Arrow batches."""

    class Places:
        def eval(self, text: str | None) -> Iterator[tuple[int, int, int, str]]:
            if text is not None:
                for i, place in enumerate(detect(text)):
                    yield (i, *place)

    spark.udtf.register(name, F.udtf(Places, returnType=PLACES, useArrow=True))


def register_findings(spark: SparkSession, pack: str, view: str, name: str, text_col: str = "text") -> None:
    """Make the findings of a view's texts by a pack the view ``name``, with all columns of the view."""
    from glyphward.operators.scanning import explode_findings, scan

    rows = spark.table(view)
    explode_findings(scan(rows, pack, text_col), *rows.columns).createOrReplaceTempView(name)
