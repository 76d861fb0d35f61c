"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import decontam, linededup, packing, quality, similar
from vigilake.llm.queries import tokenizer_path
from vigilake.llm.storage import written
from vigilake.session import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go from the texts; n_chars follows."""
    shorter = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return shorter.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return similar.keep_one(docs, size=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


def _ready(stage):
    return lambda spark, docs, sf_dir: stage(importable(spark), docs, sf_dir)


STAGES = [
    ("quality_rules", _ready(quality_rules)),
    ("line_dedup", _ready(line_dedup)),
    ("near_dedup", _ready(near_dedup)),
    ("decontamination", _ready(decontamination)),
    ("packing", _ready(pack_sequences)),
]
#: Fingerprints and packing can't be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each result written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
