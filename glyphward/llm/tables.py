"""Reading tables and keeping intermediate ones in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="glyphward-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or else the one of ``setCheckpointDir``.

    Where both are unset, a session on one machine gets a temporary folder of its process; on a
    cluster no folder of one machine would do, so that is the warehouse, which executors write to.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)  # not local-cluster
        found = _temporary() if one_machine else spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread of files, not a rerun.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphward-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete the files of tables made by :func:`save` that no later plan reads."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


TEXTS_IN_BATCH = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting the rows that its session hands to a Python worker at once to TEXTS_IN_BATCH at most: rows that hold whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= TEXTS_IN_BATCH:
        df.sparkSession.conf.set(key, str(TEXTS_IN_BATCH))
    return df


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``: the held-out rule of the scored operators."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
