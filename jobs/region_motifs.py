"""Motif sequences of regions: the motif hits inside each region, without self-overlaps, numbered, and weighted by how much regions
favour their motif over the genome. Chaining and searching start from this table.

    python -m jobs.region_motifs --tables /data/sf0.1 --out /data/region_motifs --config jobs/region_motifs.json

A batch job. It reads motif hits and regions (the views `fimo` and `regions` of the tables), and writes Parquet partitioned by
chromosome. A run replaces the whole output; with `chromosomes` set, only their partitions (dynamic partition overwrite), and a
chromosome without rows any more keeps its old ones, which is logged. So a run again gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.operators import occurrences, weights
from colinear.session import forget, stored
from colinear.views import view
from jobs.common import command_line, log

SCHEMA = "acr string, pos int, motif string, start_pos int, stop_pos int, score double, z_score double, chrom string"


@dataclass(frozen=True)
class Options:
    #: Weight of a motif's rarity in the genome.
    rarity: float = 0.5
    #: Motifs of a smaller z-score are left out; null: none.
    least_z: float | None = None
    #: Only these chromosomes are written; null: all. Weights are by all of them.
    chromosomes: tuple[str, ...] | None = None


def rows(hits: DataFrame, regions: DataFrame, options: Options = Options(), held: list[DataFrame] | None = None) -> DataFrame:
    """hits (motif, chrom, start_pos, stop_pos), regions (acr, chrom, start_pos, stop_pos) -> a row for each motif of a region.

    held takes the tables that the rows are read from; they may be forgotten when the rows are written.
    """
    inside = occurrences.within_regions(hits.select("motif", "chrom", "start_pos", "stop_pos"), regions.select("acr", "chrom", "start_pos", "stop_pos"))
    inside = stored(inside)  # for weights and rows: placed once
    relevant = weights.relevance(inside, hits).where("total_acr > 0 and total_full > 0")
    if options.least_z is not None:
        relevant = relevant.where(F.col("z_score") >= options.least_z)
    relevant = stored(relevant)
    if held is not None:
        held += [inside, relevant]
    scores = weights.motif_scores(relevant, options.rarity).select("motif", "score").join(relevant.select("motif", "z_score"), "motif")
    wanted = inside if options.chromosomes is None else inside.where(F.col("chrom").isin(list(options.chromosomes)))
    clean = occurrences.without_self_overlaps(wanted, ["motif", "acr"], F.col("stop_pos") - F.col("start_pos"))
    return occurrences.numbered(clean).join(scores, "motif").select("acr", "pos", "motif", "start_pos", "stop_pos", "score", "z_score", "chrom")


def run(spark: SparkSession, tables: str, out: str, options: Options = Options()) -> None:
    hits, regions = view(spark, tables, "fimo"), view(spark, tables, "regions")
    log.info("read %d motif hits and %d regions of %s", hits.count(), regions.count(), tables)
    known = stored(occurrences.distinct_occurrences(hits, ["motif", "chrom", "start_pos"]))
    # ranges of (chromosome, region): few files each, and a chromosome that holds most rows is split
    held = [known]
    placed = rows(known, regions, options, held).repartitionByRange("chrom", "acr").sortWithinPartitions("chrom", "acr", "pos")
    mode = "static" if options.chromosomes is None else "dynamic"
    placed.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("chrom").parquet(out)
    for table in held:
        forget(table)
    written = {r.chrom: r["count"] for r in output(spark, out).groupBy("chrom").count().collect()}  # a row a chromosome
    for chrom in sorted(written if options.chromosomes is None else options.chromosomes, key=str):
        log.info("%s of %s: %s rows", chrom, out, written.get(chrom, "no"))


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


if __name__ == "__main__":
    command_line(Options, run, {"tables": "folder of the tables", "out": "folder to write"})
