"""Motif occurrences: overlap removal, breaks, numbering and placement in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.operators.sampling import ranked
from colinear.operators.stretches import STRETCH, carried, dealt, within


#: Bases beyond its stretch that a row is looked at with; longer occurrences are an error.
HALO = 1 << 16


def without_self_overlaps(occ: DataFrame, keys: list[str], span: F.Column, start: str = "start_pos") -> DataFrame:
    """Drops an occurrence if the next one of its keys starts within `span` bases of it (HALO at most).

    Rows are windowed by keys and stretch; those that start within HALO bases of a stretch's begin are seen by the stretch before, too.
    So a motif that has most of a chromosome's rows is no one task's, at one shuffle. Rows without a start stay.
    """
    own = F.floor(F.col(start) / STRETCH).cast("long")
    seen = F.when(F.col(start) - own * STRETCH < HALO, F.array(own, own - 1)).otherwise(F.array(own))
    rows = occ.withColumn("_own", own).withColumn("_seen", F.explode(seen))
    gap = F.lead(start).over(Window.partitionBy(*keys, "_seen").orderBy(start)) - F.col(start)
    kept = rows.withColumn("_gap", gap).where(F.col("_own").eqNullSafe(F.col("_seen")))
    fits = F.when(span > HALO, F.raise_error(F.lit(f"without_self_overlaps: an occurrence of over {HALO} bases"))).otherwise(F.col("_gap") > span)
    return kept.where(F.col("_gap").isNull() | fits).drop("_gap", "_own", "_seen")


def distinct_occurrences(occ: DataFrame, keys: list[str], stop: str = "stop_pos") -> DataFrame:
    """One row for each key; of several stops the largest."""
    return occ.groupBy(*keys).agg(F.max(stop).alias(stop))


def relabelled(occ: DataFrame, clusters: DataFrame, motif: str = "motif", strict: bool = True) -> DataFrame:
    """Motifs replaced by their cluster (motif, cluster). strict: an unmapped motif is an error, else it goes."""
    out = occ.join(clusters.select(F.col("motif").alias("_m"), "cluster"), occ[motif] == F.col("_m"), "left").drop("_m")
    if strict:
        mapped = F.when(F.col("cluster").isNull(), F.raise_error(F.concat(F.lit("unmapped motif: "), F.col(motif)))).otherwise(F.col("cluster"))
        return out.withColumn(motif, mapped).drop("cluster")
    return out.where("cluster is not null").withColumn(motif, F.col("cluster")).drop("cluster")


def with_breaks(occ: DataFrame, distance: int = 3000, compat: bool = False, start: str = "start_pos") -> DataFrame:
    """Adds break_before: the start lies `distance` or more after the one before on its chromosome.

    compat: a chromosome's first start counts as following position 10,000,000, as published; else it has no break.
    """
    rows = carried(dealt(occ, start), "chrom", {"last": F.max(start)}, {"_last": F.max("_t_last")})
    before = F.coalesce(F.lag(start).over(within("chrom").orderBy(start, "motif")), "_last")
    gap = F.col(start) - (F.coalesce(before, F.lit(10_000_000)) if compat else before)
    return rows.withColumn("break_before", F.coalesce(gap >= distance, F.lit(False))).drop("_b", "_last")


def numbered(occ: DataFrame, group: str = "acr", start: str = "start_pos") -> DataFrame:
    """Adds pos: the 0-based rank of the start among the group's distinct starts."""
    rows = carried(dealt(occ, start), group, {"n": F.count_distinct(start)}, {"_n": F.sum("_t_n")})
    rank = F.dense_rank().over(within(group).orderBy(start)) - 1
    return rows.withColumn("pos", (rank + F.coalesce("_n", F.lit(0))).cast("int")).drop("_b", "_n")


def indexed(occ: DataFrame, group: str = "chrom", start: str = "start_pos") -> DataFrame:
    """Adds idx: the 0-based row number in order of start, then motif."""
    rows = carried(dealt(occ, start), group, {"n": F.count("*")}, {"_n": F.sum("_t_n")})
    place = F.row_number().over(within(group).orderBy(start, "motif")) - 1
    return rows.withColumn("idx", (place + F.coalesce("_n", F.lit(0))).cast("int")).drop("_b", "_n")


def encoded_motifs(occ: DataFrame, motif: str = "motif") -> DataFrame:
    """(motif, code): dense 0-based codes in motif order, by ranges of motifs."""
    return ranked(occ.select(motif).distinct(), [F.col(motif)], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def coded(occ: DataFrame, codes: DataFrame, motif: str = "motif") -> DataFrame:
    """Adds code by motif (motif, code); -1 for motifs without one."""
    known = codes.select(F.col("motif").alias("_m"), F.col("code").alias("_c"))
    return occ.join(known, F.col(motif) == F.col("_m"), "left").withColumn("code", F.coalesce("_c", F.lit(-1))).drop("_m", "_c")


def within_regions(hits: DataFrame, regions: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Containment as-of join: the region of the greatest start at or before a hit's start, if its stop reaches the hit's stop.

    hits: chrom, start_pos, stop_pos and more; regions: acr, chrom, start_pos, stop_pos. Regions of equal start: the last
    by identifier. Rows are windowed by chromosome and stretch of `bucket` bases, with the last region before each stretch
    brought in, so that a chromosome isn't one task's.
    """
    at = F.floor(F.col("start_pos") / bucket).cast("long")
    region = F.struct(F.col("start_pos").alias("start"), F.col("stop_pos").alias("stop"), "acr")
    marks = regions.select("chrom", at.alias("b"), F.col("start_pos").alias("s"), F.lit(0).alias("kind"), region.alias("region"))
    # the last region of each stretch stands for it in all later ones up to the next: found over stretches, not rows
    last = marks.groupBy("chrom", "b").agg(F.max("region").alias("region"))
    stretches = hits.select("chrom", at.alias("b")).distinct().join(last, ["chrom", "b"], "full")
    carried = F.last("region", True).over(Window.partitionBy("chrom").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    brought = stretches.select("chrom", "b", carried.alias("region")).where("region is not null").select("chrom", "b", F.lit(-1).cast("int").alias("s"), F.lit(-1).alias("kind"), "region")
    rows = hits.select("chrom", at.alias("b"), F.col("start_pos").alias("s"), F.lit(1).alias("kind"), F.struct(*hits.columns).alias("hit"))
    both = marks.unionByName(brought).unionByName(rows, allowMissingColumns=True)
    ordered = Window.partitionBy("chrom", "b").orderBy("s", "kind", F.col("region.acr")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.last("region", True).over(ordered)).where("kind = 1 and near.stop >= hit.stop_pos")
    return found.select("hit.*", F.col("near.acr").alias("acr"))


def reversed_copies(sequences: DataFrame) -> DataFrame:
    """(acr, motifs) and a copy of each in reverse order as `<acr>_rev`."""
    return sequences.select("acr", "motifs").union(sequences.select(F.concat("acr", F.lit("_rev")), F.reverse("motifs")))


def sequences(occ: DataFrame) -> DataFrame:
    """(acr, pos, motif) -> (acr, motifs): each region's motifs in order."""
    return occ.groupBy("acr").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "motif"))), lambda x: x["motif"]).alias("motifs"))


def sequence_lengths(occ: DataFrame) -> DataFrame:
    return occ.groupBy("acr").agg(F.count("*").alias("n_motifs"))
