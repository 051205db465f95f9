"""Interval union, difference, overlap and coverage. Intervals are closed: chrom, start_pos, stop_pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.operators.stretches import carried, dealt, within

#: Bases in a bin of the range joins.
BIN = 4096


def union(intervals: DataFrame, touching: bool = False) -> DataFrame:
    """Islands (chrom, start_pos, stop_pos) of the covered bases; touching: adjacent ones join too."""
    rows = carried(dealt(intervals.select("chrom", "start_pos", "stop_pos")), "chrom", {"stop": F.max("stop_pos")}, {"_stop": F.max("_t_stop")})
    ordered = within("chrom").orderBy("start_pos", "stop_pos")
    reach = F.greatest("_stop", F.max("stop_pos").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.col("start_pos") > reach + (1 if touching else 0)
    opened = rows.select("chrom", "start_pos", "stop_pos", "_b", F.coalesce(apart.cast("int"), F.lit(1)).alias("new"))
    islands = carried(opened, "chrom", {"new": F.sum("new")}, {"_new": F.sum("_t_new")})
    island = F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_new", F.lit(0))
    return islands.withColumn("island", island).groupBy("chrom", "island").agg(F.min("start_pos").alias("start_pos"), F.max("stop_pos").alias("stop_pos")).drop("island")


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bases of first that second doesn't cover, as islands; a sweep over both unions' ends."""
    ends = None
    for i, side in enumerate((union(first), union(second))):
        d = lambda x, i=i: [F.lit(x if i == k else 0).alias(f"d{k}") for k in (0, 1)]
        rows = side.select("chrom", F.col("start_pos").alias("at"), *d(1)).union(side.select("chrom", F.col("stop_pos") + 1, *d(-1)))
        ends = rows if ends is None else ends.union(rows)
    steps = ends.groupBy("chrom", "at").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    w = within("chrom").orderBy("at")
    steps = carried(dealt(steps, "at"), "chrom", {"d0": F.sum("d0"), "d1": F.sum("d1")}, {"_d0": F.sum("_t_d0"), "_d1": F.sum("_t_d1")})
    steps = carried(steps, "chrom", {"at": F.min("at")}, {"_next": F.min("_t_at")}, backwards=True)
    on = lambda k: (F.sum(f"d{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(f"_d{k}", F.lit(0))).alias(f"on{k}")
    swept = steps.select("chrom", "at", on(0), on(1), F.coalesce(F.lead("at").over(w), "_next").alias("next"))
    left = swept.where("on0 > 0 and on1 = 0 and next > at").select("chrom", F.col("at").alias("start_pos"), (F.col("next") - 1).alias("stop_pos"))
    return union(left, touching=True)


def _binned(df: DataFrame, start: Column, stop: Column, size: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(start, stop) / size))))


def overlapping(left: DataFrame, right: DataFrame, size: int = BIN, half_open: bool = True) -> DataFrame:
    """Pairs of overlapping intervals: columns of both as structs l and r. Both sides are dealt into bins, so that it is an
    equi-join; a pair counts in the first bin that both have. half_open: BED's meaning of a stop."""
    a, b = left.select(F.struct(*left.columns).alias("l")), right.select(F.struct(*right.columns).alias("r"))
    x = _binned(a, F.col("l.start_pos"), F.col("l.stop_pos"), size).withColumn("_chrom", F.col("l.chrom"))
    y = _binned(b, F.col("r.start_pos"), F.col("r.stop_pos"), size).withColumn("_chrom", F.col("r.chrom"))
    meets = (F.col("l.start_pos") < F.col("r.stop_pos")) & (F.col("r.start_pos") < F.col("l.stop_pos")) if half_open else (F.col("l.start_pos") <= F.col("r.stop_pos")) & (F.col("r.start_pos") <= F.col("l.stop_pos"))
    first = F.floor(F.greatest("l.start_pos", "r.start_pos") / size)
    return x.join(y, ["_chrom", "_bin"]).where(meets & (F.col("_bin") == first)).select("l", "r")


def coverage(regions: DataFrame, hits: DataFrame, size: int = BIN) -> DataFrame:
    """Adds covered (bases that the union of hits covers), length and ratio to each region (acr, chrom, start_pos, stop_pos)."""
    met = overlapping(regions, union(hits), size, half_open=False)
    bases = F.least("l.stop_pos", "r.stop_pos") - F.greatest("l.start_pos", "r.start_pos") + 1
    found = met.groupBy(F.col("l.acr").alias("acr")).agg(F.sum(bases).cast("long").alias("covered"))
    out = regions.join(found, "acr", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    size_ = (F.col("stop_pos") - F.col("start_pos") + 1).cast("long")
    return out.withColumn("length", size_).withColumn("ratio", F.col("covered") / size_)


def coverage_metrics(regions: DataFrame, hits: DataFrame, in_use: DataFrame | None = None, over: float = 0.5) -> DataFrame:
    """One row: total_ratio, mean_ratio, percent_over (regions covered by more than `over`), true_bases, false_bases.

    in_use: regions whose bases count neither as true nor as false; false are all covered bases but those and the true ones.
    """
    each = coverage(regions, hits)
    own = each.agg((F.sum("covered") / F.sum("length")).alias("total_ratio"), F.avg("ratio").alias("mean_ratio"), (100 * F.avg((F.col("ratio") > over).cast("double"))).alias("percent_over"), F.coalesce(F.sum("covered"), F.lit(0)).alias("true_bases"))
    everything = union(hits).agg(F.coalesce(F.sum(F.col("stop_pos") - F.col("start_pos") + 1), F.lit(0)).cast("long").alias("_all"))
    used = coverage(in_use, hits).agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("_used")) if in_use is not None else own.select(F.lit(0).cast("long").alias("_used"))
    return own.crossJoin(everything).crossJoin(used).withColumn("false_bases", F.col("_all") - F.col("_used") - F.col("true_bases")).drop("_all", "_used")  # a row each


def best_overlap(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """(acr, gene, overlap): the gene of each region's largest overlap; of equals the first by gene."""
    size = F.least("l.stop_pos", "r.stop_pos") - F.greatest("l.start_pos", "r.start_pos")
    met = overlapping(regions, genes).select(F.col("l.acr").alias("acr"), F.col("r.gene").alias("gene"), size.cast("int").alias("overlap"))
    top = met.groupBy("acr").agg(F.min(F.struct((-F.col("overlap")).alias("minus"), "gene")).alias("m"))
    return top.select("acr", "m.gene", (-F.col("m.minus")).alias("overlap"))


#: Bases of a genome block.
BLOCK = 1 << 16


def genome_blocks(genome: DataFrame, size: int = BLOCK) -> DataFrame:
    """(chrom, block, bases) of chromosomes (id, seq): what regions join is a block, not a chromosome."""
    n = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size)
    blocks = genome.select(F.col("id").alias("chrom"), "seq", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("block"))
    return blocks.select("chrom", "block", F.substring(F.col("seq"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("bases"))


def sliced(regions: DataFrame, genome: DataFrame, name: str = "seq", size: int = BLOCK) -> DataFrame:
    """Adds the region's bases (chrom, start_pos, stop_pos; 1-based, inclusive), from chromosomes (id, seq) or their blocks of `size`
    (chrom, block, bases); those off a chromosome's end are left out, and so are regions of other chromosomes."""
    blocks = genome if "block" in genome.columns else genome_blocks(genome, size)
    wanted = regions.select("chrom", "start_pos", "stop_pos").distinct()
    first, last = F.floor((F.greatest("start_pos", F.lit(1)) - 1) / size), F.floor((F.greatest("stop_pos", "start_pos", F.lit(1)) - 1) / size)
    met = wanted.withColumn("block", F.explode(F.sequence(first, last))).join(blocks, ["chrom", "block"])
    begin, end = F.greatest(F.col("start_pos") - F.col("block") * size, F.lit(1)), F.least(F.col("stop_pos") - F.col("block") * size, F.lit(size))
    piece = F.when(end >= begin, F.substring(F.col("bases"), begin.cast("int"), (end - begin + 1).cast("int"))).otherwise("")
    pieces = met.groupBy("chrom", "start_pos", "stop_pos").agg(F.array_sort(F.collect_list(F.struct("block", piece.alias("p")))).alias("p"))
    return regions.join(pieces.select("chrom", "start_pos", "stop_pos", F.array_join(F.transform("p", lambda x: x["p"]), "").alias(name)), ["chrom", "start_pos", "stop_pos"]).select(*regions.columns, name)
