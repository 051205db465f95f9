"""Genome search by k-mers of motifs, seed extension and sequence alignment of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions import batches
from colinear.functions.scores import extension_window, per_base
from colinear.operators.intervals import sliced

K, MULTIPLIER, MISMATCH, GAP, THRESHOLD = 4, 1.2, -1.0, -1.0, 20.0


def kmers(sequences: DataFrame, k: int = K, name: str = "acr") -> DataFrame:
    """(name, motifs) -> (name, idx, kmer, n): every run of k motifs; shorter sequences have none."""
    n = F.size("motifs")
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.cast("int").alias("idx"), F.slice("motifs", i + 1, k).alias("kmer")))
    return sequences.where(n >= k).select(name, F.inline(runs), n.alias("n"))


#: Places of a stretch of a chromosome's motifs.
PLACES = 1 << 16


def chromosome_kmers(occ: DataFrame, k: int = K) -> DataFrame:
    """(chrom, idx, motif) -> (chrom, idx, kmer) without gathering a chromosome in a row: places are dealt into stretches, and the first
    k - 1 of a stretch are seen by the one before, too; so a motif moves once, not once for each run. Runs with a place lacking are left out."""
    own = F.floor(F.col("idx") / PLACES).cast("long")
    late = (F.col("idx") - own * PLACES < k - 1) & (own > 0)
    rows = occ.select("chrom", F.col("idx").cast("int").alias("idx"), "motif", own.alias("_own"), F.explode(F.when(late, F.array(own, own - 1)).otherwise(F.array(own))).alias("_seen"))
    ahead = Window.partitionBy("chrom", "_seen").orderBy("idx")
    run = rows.select("chrom", "idx", "_own", "_seen", F.array("motif", *[F.lead("motif", i).over(ahead) for i in range(1, k)]).alias("kmer"), F.lead("idx", k - 1).over(ahead).alias("_last"))
    return run.where((F.col("_own") == F.col("_seen")) & (F.col("_last") == F.col("idx") + (k - 1))).select("chrom", "idx", "kmer")


def seeds(regions: DataFrame, occ: DataFrame, k: int = K, multiplier: float = MULTIPLIER) -> DataFrame:
    """(acr, acr_index, chrom, seq_index, win_start, win_stop): equal k-mers of a region and a chromosome, and how far an
    extension may reach.

    regions: (acr, motifs); occ: (chrom, idx, motif). Runs of k-mers are compared as text with a separator that no motif has.
    """
    key = lambda c: F.array_join(c, "\x1f")
    a = kmers(regions, k).select("acr", F.col("idx").alias("acr_index"), F.col("n").alias("acr_length"), key("kmer").alias("kmer"))
    b = chromosome_kmers(occ, k).select("chrom", F.col("idx").alias("seq_index"), key("kmer").alias("kmer"))
    sizes = occ.groupBy("chrom").agg(F.count("*").cast("int").alias("seq_length"))  # a row a chromosome
    lo, hi = extension_window(F.col("seq_index"), F.col("acr_index"), F.col("acr_length"), F.col("seq_length"), k, multiplier)
    return a.join(b, "kmer").join(sizes, "chrom").select("acr", "acr_index", "chrom", "seq_index", lo.alias("win_start"), hi.alias("win_stop"))


def extended(found: DataFrame, regions: DataFrame, occ: DataFrame, weights: DataFrame | None = None, match: float = 5.0, mismatch: float = MISMATCH, gap: float = GAP, threshold: float = THRESHOLD) -> DataFrame:
    """(acr, score, chrom, start_pos, stop_pos): seeds extended by local alignment that score above threshold.

    Seeds of one region that reach over the same window are extended once. Weighted by motif (motif, score), or `match` each.
    """
    w = weights.select("motif", F.col("score").cast("double").alias("w")) if weights is not None else None
    rows = occ.join(w, "motif", "left").withColumn("w", F.coalesce("w", F.lit(0.0))) if w is not None else occ.withColumn("w", F.lit(float(match)))
    windows = found.select("acr", "chrom", "win_start", "win_stop").distinct()
    # a window is short: its motifs are found by position, dealt into stretches so that it is an equi-join
    size = 256
    dealt = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("win_start") / size), F.floor(F.greatest("win_start", F.col("win_stop") - 1) / size))))
    placed = rows.withColumn("_b", F.floor(F.col("idx") / size))
    met = dealt.join(placed, ["chrom", "_b"]).where("idx >= win_start and idx < win_stop")
    cut = met.groupBy("acr", "chrom", "win_start", "win_stop").agg(F.array_sort(F.collect_list(F.struct("idx", "motif", "start_pos", "stop_pos", "w"))).alias("seq"))
    cases = cut.join(regions, "acr")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            acr, chrom, seq, motifs = (batch.column(batch.schema.get_field_index(c)) for c in ("acr", "chrom", "seq", "motifs"))
            of = lambda x: np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False))
            cells = seq.flatten()
            codes = pa.concat_arrays([cells.field("motif"), motifs.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            weight, start, stop = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("w", "start_pos", "stop_pos"))
            score, first, last = batches.local_alignments(of(seq), codes[: len(cells)], weight.astype(float), of(motifs), codes[len(cells) :], batch.num_rows, mismatch, gap)
            kept = np.flatnonzero(score > threshold)
            begins = (np.cumsum(np.bincount(of(seq), minlength=batch.num_rows)) - np.bincount(of(seq), minlength=batch.num_rows))[kept]
            yield pa.RecordBatch.from_arrays([acr.take(pa.array(kept)), pa.array(score[kept]), chrom.take(pa.array(kept)), pa.array(start[begins + first[kept]], pa.int32()), pa.array(stop[begins + last[kept]], pa.int32())], ["acr", "score", "chrom", "start_pos", "stop_pos"])

    return cases.mapInArrow(run, "acr string, score double, chrom string, start_pos int, stop_pos int")


def distinct_hits(hits: DataFrame, least: float | None = None, chroms: list[str] | None = None) -> DataFrame:
    """Hits without exact duplicates, of a score of `least` or more, on these chromosomes."""
    out = hits if least is None else hits.where(F.col("score") >= least)
    return (out if chroms is None else out.where(F.col("chrom").isin(chroms))).dropDuplicates()


def cut_hits(hits: DataFrame, least: float, most: float) -> DataFrame:
    """Hits of a score of `least` or more and an alignment score of `most` or less."""
    return hits.where((F.col("score") >= least) & (F.col("align_score") <= most))


#: Scores of a match, a mismatch, a gap's first and each further base: the public blastn ones.
AFFINE = (2.0, -3.0, -7.0, -2.0)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, byte) of the bytes of texts; null has none."""
    raw = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(raw) else np.zeros(0, np.uint8)
    return np.repeat(np.arange(len(raw)), np.diff(bounds)), codes.astype(np.int16)


def aligned_pairs(pairs: DataFrame, a: str = "a_seq", b: str = "b_seq", free_ends: bool = False) -> DataFrame:
    """Adds align_score, the affine alignment score of two sequence columns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sides = [batch.column(batch.schema.get_field_index(c)) for c in (a, b)]
            lost = np.logical_or(*(x.is_null().to_numpy(zero_copy_only=False) for x in sides))
            flat = [arg for x in sides for arg in _letters(x)]
            scores = pa.array(batches.affine_scores(*flat, batch.num_rows, free_ends, *AFFINE), mask=lost)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "align_score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{ddl}, align_score double")


def align_all(references: DataFrame, queries: DataFrame, blocks: int = 16) -> DataFrame:
    """(ref, query, align_score) of every reference and every query (id, seq): the stated query set against all rows.

    The queries are dealt into blocks, and each block meets all references once. Pairs are spread over all cores before they are
    aligned, as many as the result has rows, however few files and blocks they come from.
    """
    q = queries.select(F.col("id").alias("query"), F.col("seq").alias("b_seq"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("_k"))
    r = references.select(F.col("id").alias("ref"), F.col("seq").alias("a_seq"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_k"))
    tasks = 4 * references.sparkSession.sparkContext.defaultParallelism
    return aligned_pairs(r.join(q, "_k").select("ref", "query", "a_seq", "b_seq").repartition(tasks, "ref", "query")).select("ref", "query", "align_score")


def aligned_hits(hits: DataFrame, regions: DataFrame, genome: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Distinct hits with the semi-global alignment of their bases to the region's, by base of the hit.

    hits: acr, score, chrom, start_pos, stop_pos; regions: acr, a_seq (already turned for `_rev`); most: keep up to this.
    """
    cases = sliced(distinct_hits(hits, least), genome, "b_seq").join(regions, "acr")
    out = aligned_pairs(cases, "b_seq", "a_seq", True).withColumn("align_score", per_base(F.col("align_score"), F.col("start_pos"), F.col("stop_pos"))).drop("a_seq", "b_seq")
    return out if most is None else out.where(F.col("align_score") <= most)
