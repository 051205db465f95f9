"""Genes near regions and their expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.scores import gff_attribute, promoter
from colinear.operators.intervals import overlapping


def promoters(gff: DataFrame, reach: int = 2000) -> DataFrame:
    """GFF rows (chrom, feature, start_pos, stop_pos, strand, attrs, line_no) -> (chrom, start_pos, stop_pos, gene, strand).

    A 5' UTR of a gene moves its bound: the last row by line_no counts, wherever it stands.
    """
    gene = gff.where("feature = 'gene'").select("chrom", "start_pos", "stop_pos", "strand", gff_attribute(F.col("attrs"), "ID").alias("gene"))
    utr = gff.where("feature = 'five_prime_UTR'").groupBy(gff_attribute(F.col("attrs"), "Parent").alias("gene")).agg(F.max_by(F.struct(F.col("start_pos").alias("s"), F.col("stop_pos").alias("e")), "line_no").alias("utr"))
    moved = gene.join(utr, "gene", "left")
    start = F.when(F.col("strand") == "+", F.coalesce("utr.s", "start_pos")).otherwise(F.col("start_pos"))
    stop = F.when(F.col("strand") == "+", F.col("stop_pos")).otherwise(F.coalesce("utr.e", "stop_pos"))
    lo, hi = promoter(F.col("strand"), start, stop, reach)
    return moved.select("chrom", lo.cast("int").alias("start_pos"), hi.cast("int").alias("stop_pos"), "gene", "strand")


def region_genes(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """(acr, gene) of every overlap."""
    return overlapping(regions, genes).select(F.col("l.acr").alias("acr"), F.col("r.gene").alias("gene")).distinct()


def gene_sets(clustered: DataFrame, of_region: DataFrame) -> DataFrame:
    """(cluster, genes): sorted distinct genes of a cluster's regions (id, cluster); none gives an empty list."""
    met = clustered.join(of_region.withColumnRenamed("acr", "id"), "id", "left").select("cluster", "gene").distinct()
    return met.groupBy("cluster").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def gene_correlations(expression: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gene1, gene2, r): mean over common experiments of the correlation of their conditions.

    expression: gene, experiment, cond, tpm. Experiments of fewer than two conditions, or without spread, don't count.
    """
    clean = expression.where(F.col("tpm").isNotNull() & ~F.isnan(F.col("tpm").cast("double"))).select("gene", "experiment", "cond", F.col("tpm").cast("double").alias("tpm"))
    side = lambda k: clean.select(F.col("gene").alias(f"gene{k}"), "experiment", "cond", F.col("tpm").alias(f"x{k}"))
    met = pairs.select("gene1", "gene2").distinct().join(side(1), "gene1").join(side(2), ["gene2", "experiment", "cond"])
    each = met.groupBy("gene1", "gene2", "experiment").agg(F.covar_pop("x1", "x2").alias("cov"), F.count("*").alias("n"), F.stddev_pop("x1").alias("s1"), F.stddev_pop("x2").alias("s2"))
    each = each.withColumn("r", F.col("cov") / F.nullif(F.col("s1") * F.col("s2"), F.lit(0.0)))  # corr() itself fails without spread
    return each.where("n > 1 and s1 > 0 and s2 > 0").groupBy("gene1", "gene2").agg(F.avg("r").alias("r"))


def set_pairs(sets: DataFrame) -> DataFrame:
    """(cluster, genes) -> (cluster, gene1, gene2), gene1 < gene2: the unordered pairs within each gene set."""
    one = sets.select("cluster", F.explode("genes").alias("gene1"), "genes")
    return one.select("cluster", "gene1", F.explode(F.filter("genes", lambda g: g > F.col("gene1"))).alias("gene2"))


def set_correlations(sets: DataFrame, expression: DataFrame) -> DataFrame:
    """(cluster, r, n_pairs): mean correlation over a set's gene pairs that have one."""
    pairs = set_pairs(sets)
    return pairs.join(gene_correlations(expression, pairs), ["gene1", "gene2"]).groupBy("cluster").agg(F.avg("r").alias("r"), F.count("*").alias("n_pairs"))
