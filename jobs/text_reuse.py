"""Where known passages come back in new texts: the longest co-linear chain of shared word runs of every new document and every known
item, so that a passage is found with words put in, left out or changed. It treats texts as regions and word runs as motifs.

    python -m jobs.text_reuse --texts /data/documents.parquet --known /data/benchmark.parquet --out /data/reuse --checkpoint /data/reuse_mark --config jobs/text_reuse.json

A streaming job: it takes the files of `texts` (doc_id, text, lang) that no earlier run with this checkpoint took, in batches, and
ends when none is left. `known` (item_id, text) is read whole in each run. Output: Parquet partitioned by batch and language. A batch that
runs again after a failure replaces its own partitions, and a run without new files writes nothing, so a run again gives the same
table. Files that change or go after they were taken are not looked at again; known items that come later meet new texts only, and a
new checkpoint needs a new output folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.operators.chains import global_chains
from colinear.operators.texts import of_known, word_grams
from colinear.streaming.incremental import for_each_batch
from jobs.common import command_line, log

SCHEMA = "doc_id long, item_id long, chain int, n_anchors long, n_runs int, share double, batch long, lang string"


@dataclass(frozen=True)
class Options:
    #: Words of a run.
    words: int = 4
    #: Share of an item's runs that a chain has at least.
    least: float = 0.5
    #: Files of a batch at most.
    files: int = 1000


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """(acr, text): acr holds the row's columns and the text's hash, so rows that repeat are one region."""
    return df.select(F.to_json(F.struct(*columns, F.xxhash64("text").alias("h"))).alias("acr"), "text")


def reused(texts: DataFrame, known: DataFrame, options: Options = Options()) -> DataFrame:
    """texts (doc_id, text, lang), known (item_id, text) -> doc_id, item_id, chain, n_anchors, n_runs, share, lang.

    A row for each distinct text of a document and item whose chain has `least` of the item's runs. Texts of fewer than `words` words,
    empty and null ones have none. Null ids and languages stay null; an empty language counts as null. Extra columns are ignored.
    """
    items = word_grams(_named(known.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id"), options.words).distinct()
    docs = _named(texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif("lang", F.lit("")).alias("lang"), "text"), "doc_id", "lang")
    own = of_known(word_grams(docs, options.words), items).distinct()
    found = global_chains(own, items).join(items.groupBy(F.col("acr").alias("acr2")).agg(F.count("*").cast("int").alias("n_runs")), "acr2")
    field = lambda c, name, kind: F.get_json_object(c, f"$.{name}").cast(kind).alias(name)
    share = (F.col("chain") / F.col("n_runs")).alias("share")
    return found.select(field("acr1", "doc_id", "long"), field("acr2", "item_id", "long"), F.col("chain").cast("int").alias("chain"), "n_anchors", "n_runs", share, field("acr1", "lang", "string")).where(F.col("share") >= options.least)


def run(spark: SparkSession, texts: str, known: str, out: str, checkpoint: str, options: Options = Options()) -> None:
    items = spark.read.parquet(known)
    log.info("read %d known items of %s", items.count(), known)
    schema = spark.read.parquet(texts).select("doc_id", "text", "lang").schema
    path = texts.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, for the path may also be one file; a stream's plain path must be a folder
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", options.files).parquet(pattern)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = reused(batch, items, options).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.select("doc_id", "item_id", "chain", "n_anchors", "n_runs", "share", "batch", "lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(out)

    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("batch", "lang").parquet(out)  # the folder, also where no text comes
    stream = for_each_batch(arrivals, each, checkpoint)
    stream.awaitTermination()
    taken = {p["batchId"]: p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]}
    for batch, n in taken.items():
        log.info("batch %d: read %d texts of %s, wrote %d rows to %s", batch, n, texts, output(spark, out).where(F.col("batch") == batch).count(), out)
    if not taken:
        log.info("no new text in %s", texts)


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


if __name__ == "__main__":
    command_line(Options, run, {"texts": "folder of documents", "known": "known items", "out": "folder to write", "checkpoint": "folder of the stream's checkpoint"})
