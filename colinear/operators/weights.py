"""Motif frequencies, relevance and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.scores import centred, match_score, two_proportion_z


def motif_counts(occ: DataFrame, by_chrom: bool = False, chroms: list[str] | None = None) -> DataFrame:
    """(motif[, chrom], n); chroms: only these."""
    rows = occ if chroms is None else occ.where(F.col("chrom").isin(chroms))
    return rows.groupBy("motif", *(["chrom"] if by_chrom else [])).agg(F.count("*").alias("n"))


def counts_by_chrom(occ: DataFrame, chroms: list[str]) -> DataFrame:
    """A row a motif and a column a chromosome, 0 where there is none."""
    return occ.where(F.col("chrom").isin(chroms)).groupBy("motif").pivot("chrom", chroms).count().na.fill(0)


def relevance(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """(motif, total_acr, total_full, acr_percent, full_percent, z_score) of motifs in either: shares of all occurrences
    in regions and in the genome, and the z of their difference."""
    a = regions.groupBy("motif").agg(F.count("*").alias("total_acr"))
    b = genome.groupBy("motif").agg(F.count("*").alias("total_full"))
    both = a.join(b, "motif", "full").select("motif", F.coalesce("total_acr", F.lit(0)).alias("total_acr"), F.coalesce("total_full", F.lit(0)).alias("total_full"))
    sums = both.agg(F.sum("total_acr").alias("_na"), F.sum("total_full").alias("_nf"))
    wide = both.crossJoin(F.broadcast(sums))  # one row
    share = lambda x, n: F.coalesce(F.col(x) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    return wide.select("motif", "total_acr", "total_full", share("total_acr", "_na").alias("acr_percent"), share("total_full", "_nf").alias("full_percent"), two_proportion_z(F.col("total_acr"), F.col("_na"), F.col("total_full"), F.col("_nf")).alias("z_score"))


def motif_scores(relevant: DataFrame, rarity: float = 0.0) -> DataFrame:
    """(motif, score, acr_percent, full_percent) by log-odds; motifs that either side lacks are an error."""
    return relevant.select("motif", match_score(F.col("acr_percent"), F.col("full_percent"), rarity).alias("score"), "acr_percent", "full_percent")


def centred_scores(scores: DataFrame, center: float = 5.0) -> DataFrame:
    """(motif, score) with a mean of `center` over the distinct motifs."""
    each = scores.select("motif", "score").dropDuplicates(["motif"])
    mean = each.agg(F.avg("score").alias("_mean"))
    return each.crossJoin(F.broadcast(mean)).select("motif", centred(F.col("score"), F.col("_mean"), center).alias("score"))  # one row
