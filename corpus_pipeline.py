"""The corpus pipeline: documents in, token ids of what is worth training on out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colinear.llm.decontaminate import decontaminated
from colinear.llm.linededup import without_boilerplate
from colinear.llm.near_dedup import deduplicated
from colinear.llm.pieces import encoded
from colinear.llm.quality_model import fit, graded, kept_rows, sample_features
from colinear.session import stored, table

#: The fits and the sketches have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade (good and not toxic) is the likelier outcome."""
    return kept_rows(docs, fit(sample_features(graded(docs, table(spark, sf_dir, "labels"))), 3))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines, unless nothing else is in them."""
    return without_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return encoded(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
