"""Readers of the text formats. Each gives a long-form table with a fixed schema; gzip and folders come for free."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.functions.regions import parse_regions
from colinear.operators.intervals import BLOCK
from colinear.operators.statistics import pair_scores


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def _tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False, comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "").option("mode", "PERMISSIVE").schema(schema)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def in_order(rows: DataFrame, name: str = "line_no") -> DataFrame:
    """Adds an orderable place: file name, offset of the split, row within it. (Spark packs splits of files by size.)"""
    return rows.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")))


def fimo(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(motif_id, seq_name, start_pos, stop_pos) of FIMO tables; rows without a stop (trailing comments) go."""
    rows = _tsv(spark, path, "motif_id string, alt string, seq_name string, start_pos int, stop_pos int", True)
    return rows.where("stop_pos is not null").drop("alt")


def fimo_regions(spark: SparkSession, path: str | list[str], side: str | None = None) -> DataFrame:
    """(acr, motif, start_pos[, side]): distinct starts of each motif in each region; the motif is what follows the first '-'."""
    out = fimo(spark, path).select(F.col("seq_name").alias("acr"), F.split("motif_id", "-")[1].alias("motif"), "start_pos").distinct()
    return out if side is None else out.withColumn("side", F.lit(side))


def fimo_genome(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(motif, chrom, start_pos, stop_pos): one row for a motif, chromosome and start; of several stops the largest."""
    rows = fimo(spark, path).select(F.col("motif_id").alias("motif"), F.col("seq_name").alias("chrom"), "start_pos", "stop_pos")
    return rows.groupBy("motif", "chrom", "start_pos").agg(F.max("stop_pos").alias("stop_pos"))


def _blocks(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")


def motif_blocks(spark: SparkSession, path: str | list[str], side: str | None = None) -> DataFrame:
    """(acr, motifs[, side]) of block files: `ACR: <id>`, then a motif a line. A block without motifs has an empty list."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = _blocks(spark, path, "ACR: ").select(lines.alias("v"))
    out = rows.select(F.col("v")[0].alias("acr"), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("motifs"))
    return out if side is None else out.withColumn("side", F.lit(side))


def motif_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(acr, pos, motif) of block files."""
    return motif_blocks(spark, path).select("acr", F.posexplode("motifs").alias("pos", "motif"))


def two_sets(spark: SparkSession, a: str, b: str, kind: str = "blocks") -> DataFrame:
    """Both sides in one table, by the column side: 'a' or 'b'."""
    read = motif_blocks if kind == "blocks" else fimo_regions
    return read(spark, a, "a").unionByName(read(spark, b, "b"))


def chromosome_motifs(spark: SparkSession, path: str, chroms: list[str] | None = None, keep_breaks: bool = False) -> DataFrame:
    """(chrom, idx, motif, start_pos, stop_pos, is_break) of a folder with a file for each chromosome, or one `chrom=` folder each.

    idx is the place among the motifs in order of start; BREAK lines have none and come only with keep_breaks.
    """
    from colinear.operators.occurrences import indexed

    rows = _tsv(spark, path, "motif string, start_pos int, stop_pos int")
    name = F.regexp_extract(F.input_file_name(), r"chrom=([^/]+)/[^/]*$", 1)
    plain = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?(?:\.(?:gz|bz2|zst|deflate))?$", 1)
    rows = rows.select(F.when(name != "", name).otherwise(plain).alias("chrom"), "motif", "start_pos", "stop_pos", (F.col("motif") == "BREAK").alias("is_break"))
    rows = rows if chroms is None else rows.where(F.col("chrom").isin(chroms))
    own = indexed(rows.where(~F.col("is_break") & F.col("start_pos").isNotNull()))
    return own if not keep_breaks else own.unionByName(rows.where("is_break"), allowMissingColumns=True)


def fasta(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """(id, seq); the id is the header's first word."""
    rows = _blocks(spark, path, ">").select(F.split("value", "\r?\n", 2).alias("v"))
    out = rows.select(F.split(F.trim(F.col("v")[0]), r"\s+")[0].alias("id"), F.regexp_replace(F.coalesce(F.get("v", F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
    return out if chroms is None else out.where(F.col("id").isin(chroms))


def fasta_lines(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """(id, at, bases): every line of FASTA files with the 0-based place of its first base in its sequence; a header is a line without
    bases. Lines before a file's first header are left out.

    Splits of a file are read where they lie. What a split can't know, the sequence that it begins in and how far that has come,
    is brought in from one row a split; so no task and no row holds a sequence, whatever its length.
    """
    value = F.col("value")
    head = F.when(value.startswith(">"), F.split(F.trim(F.expr("substring(value, 2)")), r"\s+")[0])
    rows = in_order(spark.read.text(path).select("value", "_metadata"), "line_no")
    rows = rows.select("line_no.file", "line_no.split", "line_no.row", head.alias("head"), F.when(head.isNull(), F.regexp_replace(value, r"\s", "")).otherwise("").alias("bases"))
    up = Window.unboundedPreceding
    rows = rows.withColumn("seg", F.count("head").over(Window.partitionBy("file", "split").orderBy("row").rowsBetween(up, 0)))
    inner = Window.partitionBy("file", "split", "seg").orderBy("row")
    rows = rows.withColumns({"own": F.first("head").over(inner), "off": F.coalesce(F.sum(F.length("bases").cast("long")).over(inner.rowsBetween(up, -1)), F.lit(0).cast("long"))})
    segments = rows.groupBy("file", "split", "seg").agg(F.first("own").alias("own"), F.sum(F.length("bases").cast("long")).alias("n"))
    parts = segments.groupBy("file", "split").agg((F.max("seg") > 0).cast("int").alias("headed"), F.max_by("own", "seg").alias("last"), F.max_by("n", "seg").alias("tail"))
    by = Window.partitionBy("file").orderBy("split")  # a row a split
    parts = parts.withColumn("run", F.sum("headed").over(by.rowsBetween(up, 0)))
    parts = parts.withColumn("come", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split").rowsBetween(up, 0)))
    carried = parts.select("file", "split", F.lag("come").over(by).alias("come"), F.last("last", True).over(by.rowsBetween(up, -1)).alias("name"))
    met = rows.join(carried, ["file", "split"])
    out = met.select(F.coalesce("own", "name").alias("id"), (F.col("off") + F.when(F.col("seg") == 0, F.coalesce("come", F.lit(0))).otherwise(0)).cast("long").alias("at"), "bases").where("id is not null")
    return out if chroms is None else out.where(F.col("id").isin(chroms))


def fasta_blocks(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None, size: int = BLOCK) -> DataFrame:
    """(chrom, block, bases): sequences in blocks of `size` bases, as intervals.sliced takes them. Names are taken to be unique."""
    lines = fasta_lines(spark, path, chroms).where("bases <> ''").withColumn("to", F.col("at") + F.length("bases"))
    dealt = lines.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("to") - 1) / size))))
    lo, hi = F.greatest("at", F.col("block") * size), F.least("to", (F.col("block") + 1) * size)
    pieces = dealt.select(F.col("id").alias("chrom"), "block", F.struct(lo.alias("lo"), F.substring(F.col("bases"), (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("piece"))
    return pieces.groupBy("chrom", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["p"]), "").alias("bases"))


def chromosome_lengths(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None) -> DataFrame:
    """(chrom, length)."""
    return fasta_lines(spark, path, chroms).groupBy(F.col("id").alias("chrom")).agg(F.sum(F.length("bases")).alias("length"))


def fasta_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(region) of the header lines."""
    return _lines(spark, path).where("value like '>%'").select(F.trim(F.expr("substring(value, 2)")).alias("region"))


def region_list(spark: SparkSession, path: str | list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Distinct regions of a list, parsed, with a length from low to high where given."""
    rows = _lines(spark, path).select(F.trim("value").alias("acr")).where("acr <> ''").distinct()
    out = parse_regions(rows)
    return out if low is None else out.where(F.col("length").between(low, high))


def pair_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(r1, r2, score) with the smaller region first; of repeated pairs the last line of the file counts."""
    rows = in_order(_tsv(spark, path, "r1 string, r2 string, score double"))
    return pair_scores(rows.where("score is not null"))


def motif_scores(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "motif string, score double, acr_percent double, full_percent double", True)


def motif_relevance(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "motif string, total_acr long, total_full long, acr_percent double, full_percent double, z_score double", True)


def motif_clusters(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "motif string, cluster string")


def meme(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(motif, pssm) of MEME files: matrices of rows of four numbers."""
    rows = _blocks(spark, path, "MOTIF ").where("value like '%letter-probability matrix%'")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.rlike(r"^\s*[-+.0-9eE]+(\s+[-+.0-9eE]+){3}\s*$"))
    return rows.select(F.split("value", r"\s+")[0].alias("motif"), F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double"))).alias("pssm"))


def tomtom(spark: SparkSession, path: str) -> DataFrame:
    """(query, target, evalue); the names of the columns vary by version."""
    rows = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    known = {"query_id": "query", "query id": "query", "#query id": "query", "target_id": "target", "target id": "target", "e-value": "evalue"}
    own = rows.select(*[F.col(f"`{c}`").alias(known[c.strip().lower()]) for c in rows.columns if c.strip().lower() in known])
    return own.where("target is not null").withColumn("evalue", F.col("evalue").cast("double"))


def gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """GFF3 rows with line_no; comments and rows of fewer than nine fields go."""
    rows = _tsv(spark, path, "chrom string, source string, feature string, start_pos int, stop_pos int, score string, strand string, phase string, attrs string", comment="#")
    return in_order(rows).where("attrs is not null")


def region_gene_overlaps(spark: SparkSession, path: str) -> DataFrame:
    """(acr, a_start, a_stop, gene, g_start, g_stop) of a 4 + 6 column overlap table."""
    rows = _tsv(spark, path, "c0 string, a_start int, a_stop int, acr string, g0 string, g_start int, g_stop int, gene string, g_score string, strand string")
    return rows.select("acr", "a_start", "a_stop", "gene", "g_start", "g_stop", "strand")


def bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, start_pos int, stop_pos int, name string, score string, strand string")


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, representative, members) of `Cluster no: N, Representative: R` lines, each followed by its members."""
    rows = _blocks(spark, path, "Cluster no: ").select(F.split("value", "\r?\n").alias("v"))
    head = F.split(F.col("v")[0], ", Representative: ")
    return rows.select(head[0].cast("int").alias("cluster"), F.trim(head[1]).alias("representative"), F.filter(F.split(F.coalesce(F.get("v", F.lit(1)), F.lit("")), "\t"), lambda x: F.trim(x) != "").alias("members"))


def gene_set_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, genes) of line pairs; a header line is one without a tab that names a cluster."""
    rows = _blocks(spark, path, "Cluster ").select(F.split("value", "\r?\n").alias("v"))
    return rows.select(F.concat(F.lit("Cluster "), F.trim(F.col("v")[0])).alias("cluster"), F.filter(F.split(F.coalesce(F.get("v", F.lit(1)), F.lit("")), "\t"), lambda x: F.trim(x) != "").alias("genes"))


def expression_zip(spark: SparkSession, path: str, pattern: str = "*/*tpms.tsv") -> DataFrame:
    """(gene, experiment, cond, tpm) of the matching tables in zip files; a condition is the mean of its comma-joined replicates."""
    return expression_rows(spark.read.format("binaryFile").load(path), pattern)


def expression_rows(files: DataFrame, pattern: str = "*/*tpms.tsv") -> DataFrame:
    """The same of zip files as rows (content)."""
    schema = pa.schema([("gene", pa.string()), ("experiment", pa.string()), ("cond", pa.int32()), ("tpm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if fnmatch(name, pattern):
                            rows = []
                            for line in z.read(name).decode().splitlines()[1:]:
                                gene, _, *conds = line.split("\t")
                                for k, x in enumerate(conds):
                                    v = [float(y) for y in x.split(",") if y.strip()]
                                    rows.append({"gene": gene, "experiment": name.rsplit("/", 1)[0], "cond": k, "tpm": sum(v) / len(v) if v else None})
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(run, "gene string, experiment string, cond int, tpm double")


def frequency_file(spark: SparkSession, path: str) -> DataFrame:
    """(value, freq); short lines go."""
    return _tsv(spark, path, "value double, freq long").where("freq is not null")


def search_hits(spark: SparkSession, path: str, kind: str = "cre", least: float | None = None, chroms: list[str] | None = None) -> DataFrame:
    """(acr, score, chrom, start_pos, stop_pos, align_score) of search output ('cre': two header lines) or NCBI tables ('ncbi',
    score is the E-value and `least` its largest)."""
    if kind == "ncbi":
        rows = _tsv(spark, path, ", ".join(["chrom string"] + [f"c{i} string" for i in range(1, 6)] + ["start_pos int", "stop_pos int", "c8 string", "c9 string", "score double", "c11 string"]))
        rows = rows.select(F.lit(None).cast("string").alias("acr"), "score", "chrom", F.least("start_pos", "stop_pos").alias("start_pos"), F.greatest("start_pos", "stop_pos").alias("stop_pos"), F.lit(None).cast("double").alias("align_score"))
        rows = rows if least is None else rows.where(F.col("score") <= least)
    else:
        rows = _tsv(spark, path, "acr string, score double, chrom string, start_pos int, stop_pos int, align_score double").where("stop_pos is not null")
        rows = rows if least is None else rows.where(F.col("score") >= least)
    return rows if chroms is None else rows.where(F.col("chrom").isin(chroms))
