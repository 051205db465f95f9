"""Writers of the text formats, in parallel: a folder of part files whose order carries no meaning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """(value) with a head before the rows of each part file that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if batch.num_rows:
                if first:
                    yield pa.RecordBatch.from_pydict({"value": [head]}, schema=batch.schema)
                first = False
                yield batch

    return lines.mapInArrow(run, "value string")


def tsv(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def chromosome_motifs(occ: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """motif, start, stop a line and BREAK before gaps (break_before), a folder `chrom=` for each chromosome, in order of start.

    A chromosome is dealt into ranges of starts, and its part files' names are in their order, so no chromosome is one task's.
    """
    line = F.concat_ws("\t", "motif", F.col("start_pos").cast("string"), F.col("stop_pos").cast("string"))
    value = F.when(F.col("break_before"), F.concat(F.lit("BREAK\n"), line)).otherwise(line)
    occ.repartitionByRange("chrom", "start_pos", "motif").sortWithinPartitions("chrom", "start_pos", "motif").select("chrom", value.alias("value")).write.mode(mode).partitionBy("chrom").text(path)


def motif_blocks(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(acr, motifs) as blocks; also consensus sequences."""
    sequences.select(F.concat(F.lit("ACR: "), F.col("acr").cast("string"), F.when(F.size("motifs") > 0, F.concat(F.lit("\n"), F.array_join("motifs", "\n"))).otherwise("")).alias("value")).write.mode(mode).text(path)


def consensus_blocks(consensus: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(cluster, tokens) as blocks named cluster_<n>."""
    motif_blocks(consensus.select(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("acr"), F.col("tokens").alias("motifs")), path, mode)


def search_hits(hits: DataFrame, path: str, parameters: dict[str, object] | None = None, mode: str = "errorifexists") -> None:
    """acr, score, chrom, start_pos, stop_pos[, align_score] as lines; each part file begins with a line of the search's parameters
    and one of the columns' names, with `Alignment Score` for hits that are aligned."""
    columns = ["acr", "score", "chrom", "start_pos", "stop_pos", *(["align_score"] if "align_score" in hits.columns else [])]
    names = ["ACR", "Score", "Chromosome", "Start", "Stop", "Alignment Score"][: len(columns)]
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = "\t".join(f"{k}={v}" for k, v in (parameters or {}).items()) + "\n" + "\t".join(names)
    _headed(hits.select(value.alias("value")), head).write.mode(mode).text(path)


def motif_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tsv(scores, path, True, mode)


def motif_relevance(relevant: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """In descending order of z over the part files."""
    tsv(relevant.orderBy(F.desc("z_score"), "motif"), path, True, mode)


def bed(df: DataFrame, path: str, columns: int = 4, mode: str = "errorifexists") -> None:
    """chrom, start_pos, stop_pos, name, and with six columns score (0 where there is none) and strand."""
    score = F.col("score") if "score" in df.columns else F.lit(0)
    rows = df.select("chrom", "start_pos", "stop_pos", "name", *([score.alias("score"), "strand"] if columns == 6 else []))
    tsv(rows, path, mode=mode)


def cluster_file(clusters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(cluster, representative, members) as line pairs."""
    value = F.concat(F.lit("Cluster no: "), F.col("cluster").cast("string"), F.lit(", Representative: "), F.col("representative").cast("string"), F.lit("\n"), F.array_join("members", "\t"))
    clusters.select(value.alias("value")).write.mode(mode).text(path)


def gene_set_file(sets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(cluster, genes) as line pairs."""
    name = F.when(F.col("cluster").cast("string").startswith("Cluster "), F.col("cluster").cast("string")).otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    sets.select(F.concat(name, F.lit("\n"), F.array_join("genes", "\t")).alias("value")).write.mode(mode).text(path)


def frequency_file(freq: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tsv(freq.select("value", "freq"), path, mode=mode)


# Fixed value: the head of a minimal MEME motif file.
MEME_HEAD = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"


def meme(motifs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(motif, pssm) as MEME text, six decimals; each part file has the head."""
    numbers = F.array_join(F.transform("pssm", lambda r: F.array_join(F.transform(r, lambda v: F.format_string("%.6f", v)), " ")), "\n")
    value = F.concat(F.lit("MOTIF "), F.col("motif").cast("string"), F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("pssm").cast("string"), F.lit("\n"), numbers, F.lit("\n"))
    _headed(motifs.select(value.alias("value")), MEME_HEAD).write.mode(mode).text(path)


def fasta(sequences: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None, width: int | None = None) -> None:
    """(id, seq); files: into this many parts of consecutive ids; width: bases a line."""
    rows = sequences if files is None else sequences.repartitionByRange(files, "id").sortWithinPartitions("id")
    seq = F.col("seq") if width is None else F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"))
    rows.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), seq).alias("value")).write.mode(mode).text(path)
