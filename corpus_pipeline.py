"""A training-data pipeline of five operators over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes what a stage
returns as Parquet to the shared folder and reads it again as the next one's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.llm.mixing_ipf import mix
from glyphward.llm.packing import pack_digests
from glyphward.llm.quality_cnn import fit_quality, score_quality
from glyphward.llm.queries import tokenizer_path
from glyphward.llm.simhash_ball import fingerprint_of, fingerprints, print_groups
from glyphward.llm.tables import drop, save, small_batches, table
from glyphward.llm.toxicity_crf import fit_toxicity, score_toxicity

TOXIC_FROM = 0.3
GOOD_FROM = 0.5
KEPT_TOKENS = 0.75  # share of the tokens that the mix is expected to keep
MARK = "__pipeline_mark"  # a column that no table of documents has


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM."""
    field = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, field, MARK).where(F.col(MARK)["score"] < TOXIC_FROM).drop(MARK)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD_FROM."""
    net = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_quality(docs, net, MARK).where(F.col(MARK) >= GOOD_FROM).drop(MARK)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, then of the smallest text.

    Groups are of texts, so an id on texts of several groups can lead each of them. A group without
    ids is led by its smallest text.
    """
    prints = save(fingerprints(docs), "prints")
    groups = print_groups(prints)
    leaders = save(prints.join(groups, "fp").where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "leaders")
    often = prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    once, repeated = (save(leaders.join(often, leaders.doc_id == often.id, how).select("doc_id"), "leaders") for how in ("left_anti", "left_semi"))
    # rows that their id does not tell apart: their group is that of their text
    alike = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull())).dropDuplicates(["doc_id", "text"])
    alike = small_batches(alike).withColumn(MARK, fingerprint_of(F.col("text").cast("binary")))
    alike = alike.join(groups, alike[MARK] == groups.fp).where(alike.doc_id.eqNullSafe(groups.component_id))
    row = F.struct(*(alike[c] for c in docs.columns))
    least = alike.groupBy("root").agg(F.min_by(row, F.struct(alike.text)).alias(MARK)).select(f"{MARK}.*")
    # merged at every size: the ids grow with the documents, so they are no table to broadcast
    return docs.join(once.hint("merge"), "doc_id", "left_semi").select(*docs.columns).unionByName(least)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the raked weights of their source, language and topic."""
    return mix(docs, keep=KEPT_TOKENS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return pack_digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("SimHash near-dedup", simhash_near_dedup), ("mixing sources to target weights", mixing), ("packing", packing)]

ORACLE_SQL = None  # learned models, fingerprints and tokenizers are beyond SQL; the tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            drop(before)
    return docs
