"""Composite jobs: tables in, tables out. Each is a composition of the operators under one set of options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.regions import endpoints, length
from colinear.operators import chains, clustering, genes, intervals, occurrences, sampling, search, weights
from colinear.operators import statistics as st
from colinear.plans.options import ChainOptions, ClusterOptions, RankOptions, SearchOptions


def pairwise_chains(occ: DataFrame, other: DataFrame | None = None, scores: DataFrame | None = None, options: ChainOptions = ChainOptions()) -> DataFrame:
    """Chains of all pairs of regions (acr, motif, start_pos or pos), or of all regions of occ with all of other."""

    def placed(df: DataFrame | None) -> DataFrame | None:
        if df is None or "start_pos" not in df.columns:
            return df
        if options.local and options.renumber:
            return occurrences.numbered(df)
        return df.withColumn("pos", F.col("start_pos"))

    use = None
    if options.weighted:
        use = scores if options.center is None else weights.centred_scores(scores, options.center)
    if options.local:
        return chains.local_chains(placed(occ), placed(other), use, options.missing_weight, options.match, options.mismatch, options.gap, options.compat)
    return chains.global_chains(placed(occ), placed(other), use, options.missing_weight)


def genome_sequence(hits: DataFrame, motif_clusters: DataFrame | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Motif hits of a genome as its ordered motif sequence with breaks: chrom, idx, motif, start_pos, stop_pos, break_before."""
    occ = hits if motif_clusters is None else occurrences.relabelled(hits, motif_clusters)
    occ = occurrences.distinct_occurrences(occ, ["motif", "chrom", "start_pos"])
    occ = occurrences.without_self_overlaps(occ, ["motif", "chrom"], F.col("stop_pos") - F.col("start_pos"))
    return occurrences.indexed(occurrences.with_breaks(occ, options.break_distance))


def region_sequences(hits: DataFrame, regions: DataFrame, motif_clusters: DataFrame | None = None, keep_empty: bool = False) -> DataFrame:
    """(acr, motifs) of the motifs that lie within each region; keep_empty: regions without one too."""
    occ = hits if motif_clusters is None else occurrences.relabelled(hits, motif_clusters)
    occ = occurrences.distinct_occurrences(occ, ["motif", "chrom", "start_pos"])
    inside = occurrences.within_regions(occ.select("motif", "chrom", "start_pos", "stop_pos"), regions)
    clean = occurrences.without_self_overlaps(inside, ["motif", "acr"], F.col("stop_pos") - F.col("start_pos"))
    out = occurrences.sequences(occurrences.indexed(clean, "acr").withColumnRenamed("idx", "pos"))
    return out if not keep_empty else regions.select("acr").distinct().join(out, "acr", "left").withColumn("motifs", F.coalesce("motifs", F.array().cast("array<string>")))


def motif_weights(region_occ: DataFrame, genome_occ: DataFrame, rarity: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(relevance, scores)."""
    relevant = weights.relevance(region_occ, genome_occ)
    return relevant, weights.motif_scores(relevant.where("total_acr > 0 and total_full > 0"), rarity)


def genome_search(regions: DataFrame, genome: DataFrame, scores: DataFrame | None = None, only: DataFrame | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Hits of region sequences (acr, motifs) in a genome sequence; only: (acr) to search for."""
    wanted = regions if only is None else regions.join(only.select("acr"), "acr", "left_semi")
    wanted = occurrences.reversed_copies(wanted) if options.both_directions else wanted
    use = scores if scores is None or options.center is None else weights.centred_scores(scores, options.center)
    found = search.seeds(wanted, genome, options.k, options.multiplier)
    return search.extended(found, wanted, genome, use, options.match, options.mismatch, options.gap, options.threshold)


def aligned_search_hits(hits: DataFrame, genome: DataFrame, least: float | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Hits with the alignment of their bases to the region's own, turned for `_rev`; genome: (id, seq)."""
    named = hits.select("acr").distinct()
    lo, hi = endpoints(F.col("acr"))
    cut = intervals.sliced(named.select("acr", F.split("acr", "_")[0].alias("chrom"), lo.alias("start_pos"), hi.alias("stop_pos")), genome)
    own = cut.select("acr", F.when(F.col("acr").endswith("_rev"), F.reverse("seq")).otherwise(F.col("seq")).alias("a_seq"))
    return search.aligned_hits(hits, own, genome, least, options.align_most)


def evaluation(regions: DataFrame, hits: DataFrame, in_use: DataFrame | None = None, over: float = 0.5) -> DataFrame:
    """Coverage metrics of hits over the regions that they should find."""
    return intervals.coverage_metrics(regions, hits, in_use, over)


def difference_evaluation(regions: DataFrame, hits: DataFrame, without: DataFrame, in_use: DataFrame | None = None, over: float = 0.5) -> DataFrame:
    """The same of the bases that hits cover and without doesn't."""
    return intervals.coverage_metrics(regions, intervals.difference(hits, without), in_use, over)


def region_clusters(chained: DataFrame, sequences: DataFrame, options: ClusterOptions = ClusterOptions()) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (cluster, representative, n)) from chains and sequences (acr, motifs)."""
    from colinear.session import stored

    lengths = sequences.select("acr", F.size("motifs").alias("n_motifs"))
    distances = stored(clustering.local_distances(chained, options.beta) if options.local else clustering.chain_distances(chained, lengths, options.alpha, options.scale))
    clustered = stored(clustering.clusters(distances, options.threshold, lengths.select(F.col("acr").alias("id"))))
    return clustered, clustering.medoids(clustered, distances, more_than=options.more_than)


def cluster_consensus(clustered: DataFrame, representatives: DataFrame, sequences: DataFrame, weights_by_motif: dict[str, float] | None = None, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """(cluster, tokens) of the clusters with a representative."""
    members = clustered.join(representatives.select("cluster", "representative"), "cluster").join(sequences.select(F.col("acr").alias("id"), "motifs"), "id")
    return clustering.star_consensus(members.select("cluster", "id", "motifs", (F.col("id") == F.col("representative")).alias("is_center")), options.least_consensus, weights_by_motif)


def cluster_genes(clustered: DataFrame, regions: DataFrame, gene_table: DataFrame, best_only: bool = False) -> DataFrame:
    """(cluster, genes): of all overlaps, or of each region's largest one."""
    of_region = intervals.best_overlap(regions, gene_table).select("acr", "gene") if best_only else genes.region_genes(regions, gene_table)
    return genes.gene_sets(clustered, of_region)


def rank_frequencies(pairs: DataFrame, reference: DataFrame, reference_count: int, options: RankOptions = RankOptions(), aligned: DataFrame | None = None) -> DataFrame:
    """(rank, group, value, freq): frequencies of each region's n-th highest scores, zero padded; aligned: only pairs whose
    alignment score is low, by align_most or by the nearest rank of align_percent."""
    rows = pairs
    if aligned is not None:
        most = options.align_most
        if most is None:
            most = st.nearest_rank(aligned, options.align_percent, "align_score").first()["value"]
        rows = st.low_aligned(rows, aligned, most)
    scores = st.reference_scores(rows, reference)
    out = None
    for n in options.ranks:
        one = st.frequencies(st.nth_highest(scores, n, reference_count), "value", ["group"]).select(F.lit(n).alias("rank"), "group", "value", "freq")
        out = one if out is None else out.unionByName(one)
    return out


def normalised_rank_frequencies(pairs: DataFrame, reference: DataFrame, reference_count: int, options: RankOptions = RankOptions()) -> DataFrame:
    """The same of values normalised over both groups."""
    scores = st.reference_scores(pairs, reference)
    out = None
    for n in options.ranks:
        one = st.frequencies(st.normalised(st.nth_highest(scores, n, reference_count)), "value", ["group"]).select(F.lit(n).alias("rank"), "group", "value", "freq")
        out = one if out is None else out.unionByName(one)
    return out


def summary_frequencies(pairs: DataFrame, reference: DataFrame, reference_count: int, region_count: int) -> DataFrame:
    """(kind, group, value, freq): of all scores, the largest, the mean and the mean of the ten largest of each region."""
    scores = st.reference_scores(pairs, reference)
    kinds = {"max": st.highest(scores), "mean": st.padded_mean(scores, reference_count), "top10": st.top_mean(scores)}
    out = st.with_padding(scores, reference_count, region_count).select(F.lit("all").alias("kind"), "group", F.col("score").alias("value"), F.col("n").alias("freq"))
    for kind, values in kinds.items():
        out = out.unionByName(st.frequencies(values, "value", ["group"]).select(F.lit(kind).alias("kind"), "group", "value", "freq"))
    return out


def banded_frequencies(pairs: DataFrame, reference: DataFrame, options: RankOptions = RankOptions()) -> DataFrame:
    """(kind, low, high, group, value, freq): of all scores, the largest and the mean of each region, in each band of lengths.

    A region's scores are padded with zeros up to the number of references in the band.
    """
    bands = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in options.bands])
    inside = lambda df, c: df.where(length(*endpoints(F.col(c))).between(F.col("band.low"), F.col("band.high")))
    dealt = inside(inside(pairs.withColumn("band", F.explode(bands)), "r1"), "r2")
    known = inside(reference.withColumn("band", F.explode(bands)), "region").groupBy("band").agg(F.count("*").alias("refs"))  # a row a band
    scores = st.reference_scores(dealt.select("r1", "r2", "score", "band"), reference).join(F.broadcast(known), "band")
    each = scores.groupBy("band", "group", "region").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("max"), (F.sum("score") / F.first("refs")).alias("avg"), F.count("*").alias("n"), F.first("refs").alias("refs"))
    zeros = each.groupBy("band", "group").agg((F.sum("refs") - F.sum("n")).alias("freq")).where("freq > 0")
    every = scores.groupBy("band", "group", F.col("score").alias("value")).agg(F.count("*").alias("freq"))
    every = every.union(zeros.select("band", "group", F.lit(0.0).alias("value"), "freq")).groupBy("band", "group", "value").agg(F.sum("freq").alias("freq"))
    out = every.select(F.lit("all").alias("kind"), "band.low", "band.high", "group", "value", "freq")
    for kind in ("max", "avg"):
        out = out.union(each.groupBy(F.lit(kind).alias("kind"), "band.low", "band.high", "group", F.col(kind).alias("value")).agg(F.count("*").alias("freq")))
    return out


def blended_scores(aligned: DataFrame, chained: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """(fraction, r1, r2, value): alignment and chain scores blended at each fraction."""
    return reduce(DataFrame.union, [st.align_chain_blend(aligned, chained, f).select(F.lit(f).alias("fraction"), "r1", "r2", "value") for f in fractions])


def random_gene_sets(clustered: DataFrame, regions: DataFrame, of_region: DataFrame, seed: int) -> DataFrame:
    """(cluster, genes) of as many random regions as each cluster (id, cluster) has members: the baseline for its gene set.

    regions: (acr) to draw from, without replacement; of_region: (acr, gene), all overlaps or the best ones.
    """
    sizes = clustered.groupBy("cluster").agg(F.count("*").cast("int").alias("k"))
    drawn = sampling.sample_per_group(regions.select("acr"), sizes, "cluster", "acr", seed)
    return genes.gene_sets(drawn.withColumnRenamed("acr", "id"), of_region)


def motif_distances(similar: DataFrame, below: float) -> DataFrame:
    """(id1, id2, distance): correlation distances below a bound between the rows of the symmetric similarity matrix
    (motif1, motif2, similarity). A pair that the comparison didn't list has the similarity of an E-value of 100."""
    from colinear.session import stored

    codes = occurrences.encoded_motifs(similar, "motif1").withColumnRenamed("motif1", "motif2")  # motifs are few
    cells = stored(similar.join(codes, "motif2").groupBy(F.col("motif1").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("code", "similarity"))).alias("row")))
    n = cells.count()
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda i: F.coalesce(F.try_element_at("row", i), F.lit(-2.0)))
    return clustering.vector_distances(cells.select("id", filled.alias("x")), below)


def motif_similarity_clusters(similar: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(id, cluster): complete-linkage clusters of motifs by the correlation of their similarities to all motifs."""
    from colinear.session import stored

    near = stored(motif_distances(similar, threshold + 1e-9))
    return clustering.clusters(near, threshold, similar.select(F.col("motif1").alias("id")).distinct(), average=False, missing=2.0)


def feature_frequencies(pairs: DataFrame, reference: DataFrame, options: RankOptions = RankOptions(), n: int = 5) -> DataFrame:
    """(kind, at, group, value, freq): counts of equal scores, anchors and reference lengths at each fixed score, and combined
    scores at each fraction. pairs: r1, r2, score, n_anchors."""
    scores = st.reference_scores(pairs, reference).withColumn("ref_len", length(*endpoints(F.col("reference"))))
    features = st.nth_features(scores, n)
    parts = [("count", 0.0, features.select("group", F.col("chain_num").cast("double").alias("value")))]
    for at in options.lengths:
        parts += [(k, float(at), st.features_at(scores, float(at), c, n)) for k, c in (("anchors", "n_anchors"), ("ref_len", "ref_len"))]
    parts += [("combined", f, st.combined(features, f)) for f in options.fractions]
    out = None
    for kind, at, values in parts:
        one = st.frequencies(values, "value", ["group"]).select(F.lit(kind).alias("kind"), F.lit(at).alias("at"), "group", "value", "freq")
        out = one if out is None else out.unionByName(one)
    return out


def average_bars(freq: DataFrame, by: list[str], exclude_zero: bool = False) -> DataFrame:
    """Bar heights: weighted means by group."""
    return st.weighted_mean(freq, by, exclude_zero)


def histograms(freq: DataFrame, by: list[str], most: int, least: int = 0, equal: bool = False) -> DataFrame:
    """Trimmed bins of each group; equal: groups whose totals differ are an error."""
    bins = st.trimmed(st.histogram(freq, by, most, least))
    if equal:
        totals = [r.n for r in bins.groupBy(*by).agg(F.sum("n").alias("n")).select("n").distinct().limit(2).collect()]
        if len(totals) > 1:
            raise ValueError("histograms: the groups' totals differ")
    return bins


def rank_boxes(freq: DataFrame, most: float | None = None, ignore_zeros: bool = True) -> DataFrame:
    """(rank, group, n, low, q1, median, q3, high) of rank_frequencies: a box for each rank and group, without zeros."""
    return st.box_data(freq, ["rank", "group"], ignore_zeros, most)


def feature_boxes(freq: DataFrame, kind: str, most: float | None = None, ignore_zeros: bool = True) -> DataFrame:
    """(at, group, n, low, q1, median, q3, high) of one kind of feature_frequencies: count, anchors, ref_len or combined."""
    return st.box_data(freq.where(F.col("kind") == kind), ["at", "group"], ignore_zeros, most)
