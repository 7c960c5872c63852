"""Mergeable summaries of findings: made for each part of a table, kept, and put together later without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 12  # 2^12 registers: a standard error of 1.04 / 64
QUANTILE_SIZE = 200  # of a quantile sketch: ranks are off by 1.65 % at most, 99 times of 100
SPREAD = 4  # standard errors within which an estimate is held to be right


def finding_sketches(found: DataFrame, texts: str, size: str, *by: str) -> DataFrame:
    """(by, n, texts_sketch, sizes_sketch): for each value of ``by`` the findings, a sketch of the distinct ``texts`` and one of the quantiles of ``size``."""
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(texts, PRECISION).alias("texts_sketch"), F.kll_sketch_agg_bigint(size, QUANTILE_SIZE).alias("sizes_sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts put together: the same as of all rows at once, within the bounds."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("texts_sketch").alias("texts_sketch"), F.kll_merge_agg_bigint("sizes_sketch").alias("sizes_sketch"))


def distinct_texts(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def is_near(estimate: Column, exact: Column) -> Column:
    """Whether an estimate of distinct texts is within SPREAD standard errors."""
    return F.abs(estimate - exact) <= F.lit(SPREAD * 1.04 / 2 ** (PRECISION / 2)) * exact + 1


def quantile(sketch: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(share))
