"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_crf, mixing, sharding, simhash, tiling
from graphloom.llm.common import materialize, table
from graphloom.llm.queries import CONTAMINATED, potentials, tree


def _columns_kept(stage):
    """Columns of documents that begin with an underscore, as the operators' own do, bear other names meanwhile and come out as they were."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"given \u00b7{c}" for c in docs.columns if c.startswith("_")}
        return stage(spark, docs.withColumnsRenamed(away), sf_dir).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def _as_given(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(f"`{c}`" for c in docs.columns))


@_columns_kept
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; repeated rows fare alike."""
    return _as_given(line_crf.quality_rules(docs, potentials=potentials(spark, sf_dir)).filter("_kept"), docs)


@_columns_kept
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) one row stays, that of the least id; rows make groups, so a repeated or null id loses nothing unlike."""
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


@_columns_kept
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go; null and empty texts stay."""
    return _as_given(tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(F.col("_coverage") < CONTAMINATED), docs)


@_columns_kept
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves are cut to their share of 80 % of the tokens; none is repeated. Null languages and sources are leaves of their own, null ids come or go together."""
    return _as_given(mixing.mix(docs, tree(), fraction=0.8, max_epochs=1), docs)


@_columns_kept
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, in place of columns of these names; every row stays, null ids go by the hash of null."""
    return sharding.shuffle_shards(docs.drop("shard", "slot"), shards=40).withColumnsRenamed({"_shard": "shard", "_slot": "slot"}).drop("_bucket")


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Viterbi decoding, SimHash components and Fisher-Yates can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
