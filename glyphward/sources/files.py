"""Text files in, reports out."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.functions.text import is_blank
from glyphward.operators.registry import pack_for_file, pack_for_text


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, text): a row for each file; CR and CRLF become newlines, invalid bytes U+FFFD."""
    files = spark.read.text(list(paths), wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def route(df: DataFrame, text_col: str = "text", path_col: str | None = None, pack: str | None = None) -> DataFrame:
    """``df`` with column pack: the given one, else by the file's suffix, else by content; and blank_input, which a command line would refuse."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_file = pack_for_file(F.col(path_col)) if path_col else F.lit(None).cast("string")
    chosen = F.lit(pack) if pack else F.coalesce(by_file, pack_for_text(text))
    return df.withColumns({"pack": chosen, "blank_input": is_blank(text)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXTS_IN_TASK = 32 << 20  # bytes of files in a task at most


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt over tasks of TEXTS_IN_TASK bytes, as many as there are cores at least.

    Scanning text is bound by the processor, and a file is often one row group, which no split
    divides: so its rows are dealt anew, in the same way at every size.
    """
    df = table(spark, sf_dir, name)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TEXTS_IN_TASK)))


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="glyphward-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or else of ``setCheckpointDir``; where both are unset, a temporary one of the process on one machine, and the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)  # not local-cluster
        found = _temporary() if one_machine else spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object to a line; null fields are left out."""
    df.write.json(path)
