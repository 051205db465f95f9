"""Registered queries of the text formats and of operators around them: views go out through a writer, come back through a
reader, and are held against SQL over the same views."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.functions import regions as rg
from colinear.functions.scores import consensus_letters, per_base
from colinear.operators import clustering, genes, intervals, occurrences, search, weights
from colinear.operators import statistics as st
from colinear.operators.components import components
from colinear.operators.sampling import ranked
from colinear.plans import jobs
from colinear.plans.options import RankOptions
from colinear.queries import ASOF, DIST, FEATURES, OCC, RANKED, REL, ROLES, _by_chrom, _clean, _counts, _distances, _freq, _linkage, _promoters, _r, _relevance, query
from colinear.session import shared_folder
from colinear.sources import readers, writers
from colinear.views import view


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/formats/{uuid.uuid4().hex}"


def _through(df: DataFrame, write: Callable, read: Callable) -> DataFrame:
    """df written and read again."""
    path = _folder(df.sparkSession)
    write(df, path)
    return read(df.sparkSession, path)


def _fimo_file(rows: DataFrame, path: str) -> None:
    """Columns of a FIMO table, with its header and a trailing comment."""
    names = rows.select(F.col(rows.columns[0]).alias("motif_id"), F.lit(".").alias("motif_alt_id"), *[F.col(a).alias(b) for a, b in zip(rows.columns[1:], ("sequence_name", "start", "stop"))])
    writers.tsv(names, path, header=True)


def _region_hits(spark, d) -> DataFrame:
    return view(spark, d, "acr_motif").select("motif", "acr", F.col("pos").alias("a"), (F.col("pos") + 5).alias("b"))


@query("SELECT DISTINCT acr, split_part(motif, '-', 2) AS motif, pos AS start_pos, 'a' AS side FROM acr_motif")
def q_read_fimo_regions(spark, d):
    return _through(_region_hits(spark, d), _fimo_file, lambda s, p: readers.fimo_regions(s, p, "a"))


@query("SELECT motif, chrom, start_pos, max(stop_pos) AS stop_pos FROM fimo GROUP BY 1, 2, 3")
def q_read_fimo_genome(spark, d):
    return _through(view(spark, d, "fimo").select("motif", "chrom", "start_pos", "stop_pos"), _fimo_file, readers.fimo_genome)


@query(f"WITH {OCC}, {ASOF} SELECT motif, chrom, start_pos, stop_pos, acr FROM inside")
def q_read_fimo_inside(spark, d):
    occ = _through(view(spark, d, "fimo").select("motif", "chrom", "start_pos", "stop_pos"), _fimo_file, readers.fimo_genome)
    return occurrences.within_regions(occ, view(spark, d, "regions"))


@query("SELECT acr, pos, motif FROM acr_motif")
def q_read_blocks(spark, d):
    return _through(occurrences.sequences(view(spark, d, "acr_motif")), writers.motif_blocks, readers.motif_list)


@query("SELECT r.acr, string_agg(i.motif, ' ' ORDER BY i.pos) AS motifs, 'b' AS side FROM acrs r LEFT JOIN (SELECT acr, pos, motif FROM acr_motif WHERE motif LIKE 'click-%') i USING (acr) GROUP BY 1")
def q_read_empty_blocks(spark, d):
    some = occurrences.sequences(view(spark, d, "acr_motif").where("motif like 'click-%'"))
    every = view(spark, d, "acrs").select("acr").join(some, "acr", "left").withColumn("motifs", F.coalesce("motifs", F.array().cast("array<string>")))
    out = _through(every, writers.motif_blocks, lambda s, p: readers.motif_blocks(s, p, "b"))
    return out.select("acr", F.when(F.size("motifs") > 0, F.array_join("motifs", " ")).alias("motifs"), "side")


@query("SELECT acr, count(*) AS n, CASE WHEN acr LIKE '%_rand' THEN 'a' ELSE 'b' END AS side FROM acr_motif GROUP BY 1")
def q_read_two_sets(spark, d):
    seqs, a, b = occurrences.sequences(view(spark, d, "acr_motif")), _folder(spark), _folder(spark)
    writers.motif_blocks(seqs.where(rg.is_random(F.col("acr"))), a)
    writers.motif_blocks(seqs.where(~rg.is_random(F.col("acr"))), b)
    return readers.two_sets(spark, a, b).select("acr", F.size("motifs").cast("long").alias("n"), "side")


@query("SELECT acr, pos, motif FROM acr_motif UNION ALL SELECT concat(acr, '_rev'), count(*) OVER (PARTITION BY acr) - 1 - pos, motif FROM acr_motif")
def q_reversed(spark, d):
    turned = occurrences.reversed_copies(occurrences.sequences(view(spark, d, "acr_motif")))
    return turned.select("acr", F.posexplode("motifs").alias("pos", "motif")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {OCC} SELECT chrom, motif, start_pos, stop_pos, cast(row_number() OVER (PARTITION BY chrom ORDER BY start_pos, motif) - 1 AS int) AS idx FROM clean WHERE chrom IN ('Chr1', 'Chr3')")
def q_read_chromosomes(spark, d):
    broken = occurrences.with_breaks(_clean(spark, d), 40)
    return _through(broken, writers.chromosome_motifs, lambda s, p: readers.chromosome_motifs(s, p, ["Chr1", "Chr3"])).select("chrom", "motif", "start_pos", "stop_pos", "idx")


@query(f"WITH {OCC}, gaps AS (SELECT chrom, coalesce(start_pos - lag(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos, motif) >= 40, false) AS b FROM clean) SELECT chrom, count(*) FILTER (b) AS breaks, count(*) AS motifs FROM gaps GROUP BY 1")
def q_read_breaks(spark, d):
    back = _through(occurrences.with_breaks(_clean(spark, d), 40), writers.chromosome_motifs, lambda s, p: readers.chromosome_motifs(s, p, keep_breaks=True))
    return back.groupBy("chrom").agg(F.count_if("is_break").alias("breaks"), F.count_if(~F.col("is_break")).alias("motifs"))


GENOME = "genome AS (SELECT concat('Chr', cast(id % 5 + 1 AS varchar)) AS id, string_agg(seq, '' ORDER BY id) AS seq FROM sequences GROUP BY 1)"


def _genome(spark, d) -> DataFrame:
    parts = view(spark, d, "sequences").groupBy(F.concat(F.lit("Chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom")).agg(F.array_sort(F.collect_list(F.struct("id", "seq"))).alias("p"))
    return parts.select(F.col("chrom").alias("id"), F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


@query("SELECT cast(id AS varchar) AS id, seq FROM sequences")
def q_read_fasta(spark, d):
    return _through(view(spark, d, "sequences"), writers.fasta, readers.fasta)


@query("SELECT cast(id AS varchar) AS id, seq FROM sequences")
def q_read_fasta_split(spark, d):
    return _through(view(spark, d, "sequences"), lambda df, p: writers.fasta(df, p, files=4), readers.fasta)


@query(f"WITH {GENOME} SELECT id, seq FROM genome WHERE id IN ('Chr2', 'Chr4')")
def q_read_chromosome_fasta(spark, d):
    return _through(_genome(spark, d), writers.fasta, lambda s, p: readers.fasta(s, p, ["Chr2", "Chr4"]))


@query(f"WITH {GENOME} SELECT id AS chrom, cast(length(seq) AS bigint) AS length FROM genome")
def q_chromosome_lengths(spark, d):
    return _through(_genome(spark, d), lambda df, p: writers.fasta(df, p, width=60), readers.chromosome_lengths)


@query(f"WITH {GENOME}, b AS (SELECT id, seq, unnest(range(0, (length(seq) + 99) // 100)) AS block FROM genome) SELECT id AS chrom, cast(block AS bigint) AS block, substr(seq, cast(block * 100 + 1 AS int), 100) AS bases FROM b")
def q_read_fasta_blocks(spark, d):
    return _through(_genome(spark, d), lambda df, p: writers.fasta(df, p, width=60), lambda s, p: readers.fasta_blocks(s, p, size=100)).select("chrom", F.col("block").cast("long").alias("block"), "bases")


@query(f"WITH {GENOME} SELECT id AS region FROM genome")
def q_read_fasta_names(spark, d):
    return _through(_genome(spark, d), writers.fasta, readers.fasta_names)


@query("SELECT acr, a AS start_pos, b AS stop_pos, b - a + 1 AS length FROM (SELECT DISTINCT acr, regexp_extract(acr, '_(\\d+)to', 1)::int AS a, regexp_extract(acr, 'to(\\d+)', 1)::int AS b FROM acrs) WHERE b - a + 1 BETWEEN 500 AND 800")
def q_read_region_list(spark, d):
    names = view(spark, d, "acrs").select(F.col("acr").alias("value"))
    back = _through(names.union(names), lambda df, p: df.write.text(p), lambda s, p: readers.region_list(s, p, 500, 800))
    return back.select("acr", "start_pos", "stop_pos", "length")


@query("SELECT r1, r2, score FROM pair_lengths")
def q_read_pairs(spark, d):
    """Each pair twice, turned and with another score in an earlier file: the last one counts."""
    pairs = view(spark, d, "pair_lengths").select("r1", "r2", "score")
    both = pairs.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), F.col("score") + 1, F.lit(0).alias("k")).union(pairs.withColumn("k", F.lit(1)))
    write = lambda df, p: writers.tsv(df.repartitionByRange(2, "k").drop("k"), p)
    return _through(both, write, readers.pair_table)


@query("WITH c AS (SELECT least(r2, r1) AS a, greatest(r1, r2) AS b FROM pair_lengths) SELECT a, b FROM c")
def q_canonical(spark, d):
    a, b = rg.canonical(F.col("r2"), F.col("r1"))
    return view(spark, d, "pair_lengths").select(a.alias("a"), b.alias("b"))


@query("SELECT motif, round(score * 5.0 / avg(score) OVER (), 6) AS score FROM motif_scores")
def q_read_scores(spark, d):
    scores = view(spark, d, "motif_scores").select("motif", "score", F.lit(0.5).alias("acr_percent"), F.lit(0.25).alias("full_percent"))
    return weights.centred_scores(_through(scores, writers.motif_scores, readers.motif_scores), 5.0).select("motif", *_r("score"))


@query(f"WITH {REL} SELECT motif, total_acr, total_full, round(CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (p1 - p2) / sqrt(p * (1 - p) * (1 / na + 1 / nf)) END, 6) AS z_score FROM z")
def q_read_relevance(spark, d):
    return _through(_relevance(spark, d), writers.motif_relevance, readers.motif_relevance).select("motif", "total_acr", "total_full", *_r("z_score"))


@query(f"WITH {REL} SELECT motif, row_number() OVER (ORDER BY round(CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (p1 - p2) / sqrt(p * (1 - p) * (1 / na + 1 / nf)) END, 9) DESC, motif) AS line FROM z")
def q_relevance_order(spark, d):
    """Lines of the written relevance table, by part file and place: motifs in falling order of z."""
    path = _folder(spark)
    writers.motif_relevance(_relevance(spark, d).withColumn("z_score", F.round("z_score", 9)), path)
    lines = readers.in_order(spark.read.option("sep", "\t").option("header", True).csv(path).select("motif", "_metadata"), "at")
    return ranked(lines.select("motif", "at"), [F.col("at")], "line").select("motif", F.col("line").cast("long").alias("line"))


LOW = "low AS (SELECT p.* FROM pair_lengths p JOIN align_scores a ON a.r1 = p.r1 AND a.r2 = p.r2 WHERE a.align_score <= (SELECT align_score FROM (SELECT align_score, row_number() OVER (ORDER BY align_score) - 1 AS k, count(*) OVER () AS n FROM align_scores) WHERE k = cast(floor(30.0 * n / 100) AS bigint)))"


@query(f"""WITH {LOW}, {ROLES.replace("pair_lengths p", "low p")}, rk AS (SELECT "group", region, score, row_number() OVER (PARTITION BY "group", region ORDER BY score DESC) AS k FROM roles),
reg AS (SELECT DISTINCT "group", region FROM roles), v AS (SELECT n.n AS rank, reg."group", coalesce(rk.score, 0.0) AS value FROM reg CROSS JOIN (VALUES (1), (2), (3)) n(n) LEFT JOIN rk ON rk."group" = reg."group" AND rk.region = reg.region AND rk.k = n.n)
SELECT rank, "group", value, count(*) AS freq FROM v GROUP BY ALL""")
def q_low_aligned_ranks(spark, d):
    """Rank frequencies without the pairs whose alignment lies above the thirtieth percentile."""
    return jobs.rank_frequencies(view(spark, d, "pair_lengths"), view(spark, d, "reference"), 1000, RankOptions(ranks=(1, 2, 3), align_percent=30.0), view(spark, d, "align_scores"))


@query("SELECT 'C' || cast(length(motif) AS varchar) AS motif, count(*) AS n FROM fimo GROUP BY 1")
def q_read_motif_clusters(spark, d):
    occ = view(spark, d, "fimo")
    named = occ.select("motif").distinct().withColumn("cluster", F.concat(F.lit("C"), F.length("motif").cast("string")))
    return occurrences.relabelled(occ, _through(named, writers.tsv, readers.motif_clusters)).groupBy("motif").agg(F.count("*").alias("n"))


def _matrices(spark, d) -> DataFrame:
    """A matrix of three rows for each query sequence, in eighths."""
    eighth = lambda k: ((F.col("id") + k) % 8 / 8).cast("double")
    row = lambda k: F.array(eighth(k), eighth(k + 1), eighth(2 * k + 3), eighth(5))
    return view(spark, d, "query_sequences").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("motif"), F.array(row(0), row(1), row(2)).alias("pssm"))


ROWS = "SELECT id, k, [(id + k) % 8 / 8, (id + k + 1) % 8 / 8, (id + 2 * k + 3) % 8 / 8, (id + 5) % 8 / 8] AS r FROM query_sequences, (SELECT unnest([0, 1, 2]) AS k)"


@query(f"SELECT concat('m', cast(id AS varchar)) AS motif, cast(k AS int) AS pos, round(r[1], 6) AS a, round(r[2], 6) AS c, round(r[3], 6) AS g, round(r[4], 6) AS t FROM ({ROWS})")
def q_read_meme(spark, d):
    back = _through(_matrices(spark, d), writers.meme, readers.meme).select("motif", F.posexplode("pssm").alias("pos", "r"))
    return back.select("motif", "pos", *[F.round(F.col("r")[i], 6).alias(c) for i, c in enumerate("acgt")])


@query(f"SELECT concat('m', cast(id AS varchar)) AS motif, string_agg(substr('ACGT', list_position(r, list_max(r)), 1), '' ORDER BY k) AS letters FROM ({ROWS}) GROUP BY 1")
def q_consensus_letters(spark, d):
    return _matrices(spark, d).select("motif", consensus_letters(F.col("pssm")).alias("letters"))


@query(f"SELECT concat('Chr', cast(id % 5 AS varchar)) AS cluster, cast(k AS int) AS pos, round(avg(r[1]), 6) AS a, round(avg(r[2]), 6) AS c, round(avg(r[3]), 6) AS g, round(avg(r[4]), 6) AS t FROM (SELECT id % 5 AS id, k, r FROM (SELECT id - id % 8 AS id8, id, k, [(k) % 8 / 8, (k + 1) % 8 / 8, (2 * k + 3) % 8 / 8, 5 / 8] AS r FROM (SELECT id, k FROM query_sequences, (SELECT unnest([0, 1, 2]) AS k)))) GROUP BY 1, 2")
def q_mean_matrices(spark, d):
    """Members of the same letters: the alignment is the columns themselves."""
    eighth = lambda k: F.lit(k % 8 / 8)
    row = lambda k: F.array(eighth(k), eighth(k + 1), eighth(2 * k + 3), eighth(5))
    members = view(spark, d, "query_sequences").select(F.concat(F.lit("Chr"), (F.col("id") % 5).cast("string")).alias("cluster"), F.col("id").cast("string").alias("motif"), F.array(row(0), row(1), row(2)).alias("pssm"))
    rows = clustering.consensus_matrices(members).select("cluster", F.posexplode("pssm").alias("pos", "r"))
    return rows.select("cluster", "pos", *[F.round(F.col("r")[i], 6).alias(c) for i, c in enumerate("acgt")])


PAIRED = "SELECT cast(q AS varchar) AS x, cast(score AS varchar) AS y, abs(align_score) AS e FROM hits WHERE align_score <> 0"
LIKE = f"SELECT x AS motif1, y AS motif2, -log10(min(e)) AS similarity FROM (SELECT x, y, e FROM ({PAIRED}) UNION ALL SELECT y, x, e FROM ({PAIRED})) GROUP BY 1, 2"


def _similar(spark, d) -> DataFrame:
    h = view(spark, d, "hits").where("align_score <> 0").select(F.col("q").cast("string").alias("Query_ID"), F.col("score").cast("string").alias("Target_ID"), F.abs("align_score").alias("E-value"))
    return clustering.evalue_table(_through(h, lambda df, p: writers.tsv(df, p, header=True), readers.tomtom))


@query(f"SELECT motif1, motif2, round(similarity, 6) AS similarity FROM ({LIKE})")
def q_read_tomtom(spark, d):
    return _similar(spark, d).select("motif1", "motif2", *_r("similarity"))


def _in_turn(rows: DataFrame, path: str) -> None:
    """(value, k) as lines in order of k: part files by ranges of k, and in order within a file, as one may hold several k."""
    rows.repartitionByRange(3, "k").sortWithinPartitions("k").select("value").write.text(path)


@query("SELECT gene, chrom, cast(CASE WHEN strand = '+' THEN greatest(0, s - 201) ELSE e END AS int) AS start_pos, cast(CASE WHEN strand = '+' THEN s - 1 ELSE e + 200 END AS int) AS stop_pos, strand FROM (SELECT gene, chrom, strand, start_pos + CASE WHEN strand = '+' AND start_pos % 3 = 0 THEN 4 ELSE 0 END AS s, stop_pos - CASE WHEN strand <> '+' AND start_pos % 3 = 0 THEN 4 ELSE 0 END AS e FROM genes)")
def q_read_gff(spark, d):
    """Genes, and for some a 5' UTR twice: the later line counts."""
    g = view(spark, d, "genes")
    line = lambda feature, a, b, attrs: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(feature), a.cast("string"), b.cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    utr = lambda by, k: g.where("start_pos % 3 = 0").select(line("five_prime_UTR", F.col("start_pos") + by, F.col("stop_pos") - by, F.concat(F.lit("Parent="), "gene", F.lit(".1"))).alias("value"), F.lit(k).alias("k"))
    own = g.select(line("gene", F.col("start_pos"), F.col("stop_pos"), F.concat(F.lit("ID="), "gene", F.lit(";Name=x"))).alias("value"), F.lit(2).alias("k"))
    rows = own.union(utr(9, 0)).union(utr(4, 1)).union(spark.createDataFrame([("# comment", 0)], "value string, k int"))
    back = _through(rows, _in_turn, readers.gff)
    return genes.promoters(back, 200).select("gene", "chrom", "start_pos", "stop_pos", "strand")


@query("SELECT chrom, start_pos, stop_pos, gene AS name, '0' AS score, strand FROM genes")
def q_read_bed(spark, d):
    return _through(view(spark, d, "genes").withColumnRenamed("gene", "name"), lambda df, p: writers.bed(df, p, 6), readers.bed)


@query("SELECT r.acr, r.start_pos AS a_start, r.stop_pos AS a_stop, g.gene, g.start_pos AS g_start, g.stop_pos AS g_stop, g.strand FROM regions r JOIN genes g ON r.chrom = g.chrom AND r.start_pos < g.stop_pos AND g.start_pos < r.stop_pos")
def q_read_overlaps(spark, d):
    met = intervals.overlapping(view(spark, d, "regions"), view(spark, d, "genes"))
    rows = met.select("l.chrom", "l.start_pos", "l.stop_pos", "l.acr", F.col("r.chrom").alias("g"), F.col("r.start_pos").alias("gs"), F.col("r.stop_pos").alias("ge"), "r.gene", F.lit(0).alias("z"), "r.strand")
    return _through(rows, writers.tsv, readers.region_gene_overlaps)


def _chromosome_clusters(spark, d) -> DataFrame:
    c = view(spark, d, "acrs").groupBy(F.regexp_extract("acr", r"Chr(\d+)_", 1).cast("int").alias("cluster"))
    return c.agg(F.min("acr").alias("representative"), F.array_sort(F.collect_list("acr")).alias("members"))


@query("SELECT regexp_extract(acr, 'Chr(\\d+)_', 1)::int AS cluster, min(acr) AS representative, string_agg(acr, ',' ORDER BY acr) AS members FROM acrs GROUP BY 1")
def q_read_cluster_file(spark, d):
    return _through(_chromosome_clusters(spark, d), writers.cluster_file, readers.cluster_file).withColumn("members", F.array_join("members", ","))


@query("SELECT concat('Cluster ', chrom) AS cluster, string_agg(gene, ',' ORDER BY gene) AS genes FROM genes GROUP BY 1")
def q_read_gene_sets(spark, d):
    sets = view(spark, d, "genes").groupBy(F.col("chrom").alias("cluster")).agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    return _through(sets, writers.gene_set_file, readers.gene_set_file).withColumn("genes", F.array_join("genes", ","))


@query("SELECT gene, concat('e', experiment) AS experiment, cast(0 AS int) AS cond, round(avg(tpm), 6) AS tpm FROM expression GROUP BY 1, 2")
def q_read_expression_zip(spark, d):
    """A zip file an experiment, whose replicates stand comma-joined in one condition."""
    e = view(spark, d, "expression").groupBy("gene", "experiment").agg(F.array_join(F.collect_list(F.col("tpm").cast("string")), ",").alias("v"))

    def zipped(group: pa.Table) -> pa.Table:
        name, content = group.column("experiment")[0].as_py(), io.BytesIO()
        with zipfile.ZipFile(content, "w") as z:
            z.writestr(f"e{name}/x_tpms.tsv", "gene\tname\tc0\n" + "".join(f"{g}\t.\t{v}\n" for g, v in zip(group.column("gene").to_pylist(), group.column("v").to_pylist())))
            z.writestr(f"e{name}/notes.txt", "other")
        return pa.table({"content": pa.array([content.getvalue()], pa.binary())})

    return readers.expression_rows(e.groupBy("experiment").applyInArrow(zipped, "content binary")).select("gene", "experiment", "cond", *_r("tpm"))


@query(f"WITH {ROLES} SELECT score AS value, count(*) AS freq FROM roles GROUP BY 1")
def q_read_frequencies(spark, d):
    return _through(st.frequencies(_counts(spark, d).select(F.col("score").alias("value"), "n")), writers.frequency_file, readers.frequency_file)


@query("SELECT DISTINCT concat('r', cast(q AS varchar)) AS acr, cast(score AS double) AS score, chrom, start_pos, stop_pos, align_score FROM hits WHERE score >= 30 AND chrom IN ('Chr1', 'Chr2')")
def q_read_hits(spark, d):
    h = view(spark, d, "hits").withColumn("acr", F.concat(F.lit("r"), F.col("q").cast("string")))
    back = _through(h, lambda df, p: writers.search_hits(df, p, {"k": 4, "threshold": 20}), lambda s, p: readers.search_hits(s, p, least=30, chroms=["Chr1", "Chr2"]))
    return search.distinct_hits(back)


@query("SELECT chrom, least(start_pos, stop_pos) AS start_pos, greatest(start_pos, stop_pos) AS stop_pos, cast(abs(align_score) AS double) AS score FROM hits WHERE abs(align_score) <= 0.5")
def q_read_ncbi_hits(spark, d):
    h = view(spark, d, "hits")
    rows = h.select("chrom", *[F.lit("x").alias(f"c{i}") for i in range(1, 6)], F.col("stop_pos").alias("a"), F.col("start_pos").alias("b"), F.lit("x").alias("c8"), F.lit("x").alias("c9"), F.abs("align_score").alias("e"), F.lit("1").alias("c11"))
    return _through(rows, writers.tsv, lambda s, p: readers.search_hits(s, p, "ncbi", 0.5)).select("chrom", "start_pos", "stop_pos", "score")


@query("SELECT concat('cluster_', split_part(acr, '_', 1)) AS acr, string_agg(m, ' ' ORDER BY m) AS motifs FROM (SELECT DISTINCT acr, split_part(motif, '-', 1) AS m FROM acr_motif WHERE pos = 0) GROUP BY 1")
def q_read_consensus(spark, d):
    first = view(spark, d, "acr_motif").where("pos = 0").select("acr", F.split("motif", "-")[0].alias("m")).distinct()
    c = first.groupBy(F.split("acr", "_")[0].alias("cluster")).agg(F.array_sort(F.collect_list("m")).alias("tokens"))
    return _through(c, writers.consensus_blocks, readers.motif_blocks).select("acr", F.array_join("motifs", " ").alias("motifs"))


@query(f"WITH {GENOME} SELECT r.acr, r.chrom, r.start_pos, r.stop_pos, substr(g.seq, r.start_pos, r.stop_pos - r.start_pos + 1) AS seq FROM regions r JOIN genome g ON g.id = r.chrom WHERE r.start_pos <= length(g.seq)")
def q_sliced(spark, d):
    blocks = _through(_genome(spark, d), lambda df, p: writers.fasta(df, p, width=60), lambda s, p: readers.fasta_blocks(s, p, size=100))
    found = intervals.sliced(view(spark, d, "regions"), blocks, size=100)
    return found.where("seq <> ''")


@query("SELECT q, chrom, start_pos, round(align_score / (stop_pos + 1 - start_pos), 6) AS score FROM hits")
def q_per_base(spark, d):
    return view(spark, d, "hits").select("q", "chrom", "start_pos", F.round(per_base(F.col("align_score"), F.col("start_pos"), F.col("stop_pos")), 6).alias("score"))


@query(f'WITH {ROLES}, b AS (SELECT "group", quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, count(*) AS n FROM roles WHERE score <> 0 AND score <= 40 GROUP BY 1) SELECT b."group", cast(b.n AS bigint) AS n, min(score) AS low, b.q1, b.median, b.q3, max(score) AS high FROM b JOIN roles r ON r."group" = b."group" AND r.score BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1) AND r.score <> 0 AND r.score <= 40 GROUP BY ALL')
def q_box_whiskers(spark, d):
    return st.box_data(_freq(spark, d), ["group"], True, 40.0).select("group", "n", "low", "q1", "median", "q3", "high")


@query(f'WITH {ROLES}, h AS (SELECT "group", CASE WHEN round_even(score / 4, 0) BETWEEN 0 AND 30 THEN cast(round_even(score / 4, 0) AS int) END AS bin, count(*) AS n FROM roles GROUP BY 1, 2) SELECT "group", bin, n FROM h WHERE bin IS NULL OR bin <= (SELECT max(bin) FROM h)')
def q_trimmed(spark, d):
    return st.trimmed(st.histogram(_freq(spark, d).withColumn("value", F.col("value") / 4), ["group"], 30))


@query(f"WITH {DIST}, c AS (SELECT acr AS id, split_part(acr, '_', 1) AS cluster FROM acrs), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1) SELECT cluster, n FROM n WHERE n >= (SELECT floor(avg(n)) FROM n)")
def q_large_clusters(spark, d):
    sizes = _by_chrom(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    most = sizes.agg(F.floor(F.avg("n")).cast("int")).first()[0]
    return clustering.medoids(_by_chrom(spark, d), _distances(spark, d), more_than=most - 1).select("cluster", "n")


BANDS = "(VALUES (400, 600), (600, 800), (800, 1000)) AS band(low, high)"
SIZE = "regexp_extract({0}, 'to(\\d+)', 1)::int - regexp_extract({0}, '_(\\d+)to', 1)::int + 1 BETWEEN low AND high"
BANDED = f"banded AS (SELECT low, high, r1, r2, score FROM pair_lengths, {BANDS} WHERE {SIZE.format('r1')} AND {SIZE.format('r2')}), known AS (SELECT low, high, count(*) AS refs FROM reference, {BANDS} WHERE {SIZE.format('region')} GROUP BY 1, 2)"
BAND_ROLES = f"{BANDED}, roles AS (SELECT low, high, CASE WHEN region LIKE '%_rand' THEN 'rand' ELSE 'acr' END AS \"group\", region, score, refs FROM (SELECT low, high, CASE WHEN a OR x IS NULL THEN r1 ELSE r2 END AS region, score, x, y, a, b FROM (SELECT p.*, x.region AS x, y.region AS y, r1 LIKE '%_rand' AS a, r2 LIKE '%_rand' AS b FROM banded p LEFT JOIN reference x ON x.region = r1 LEFT JOIN reference y ON y.region = r2)) JOIN known USING (low, high) WHERE CASE WHEN a THEN y IS NOT NULL WHEN x IS NOT NULL THEN b OR y IS NULL ELSE y IS NOT NULL END)"


@query(f"""WITH {BAND_ROLES}, v AS (SELECT 'all' AS kind, low, high, "group", score AS value, count(*) AS freq FROM roles GROUP BY ALL
UNION ALL SELECT 'all', low, high, "group", 0.0, count(DISTINCT region) * max(refs) - count(*) FROM roles GROUP BY low, high, "group"
UNION ALL SELECT 'max', low, high, "group", greatest(0.0, max(score)), 1 FROM roles GROUP BY low, high, "group", region
UNION ALL SELECT 'avg', low, high, "group", round(sum(score) / max(refs), 6), 1 FROM roles GROUP BY low, high, "group", region)
SELECT kind, low, high, "group", value, cast(sum(freq) AS bigint) AS freq FROM v GROUP BY ALL HAVING sum(freq) > 0""")
def q_banded(spark, d):
    out = jobs.banded_frequencies(view(spark, d, "pair_lengths"), view(spark, d, "reference"), RankOptions(bands=((400, 600), (600, 800), (800, 1000))))
    return out.withColumn("value", F.round("value", 6)).groupBy("kind", "low", "high", "group", "value").agg(F.sum("freq").alias("freq"))


@query("WITH s AS (SELECT a.r1, a.r2, align_score, coalesce(p.score, 0) AS chain FROM align_scores a LEFT JOIN pair_lengths p ON p.r1 = a.r1 AND p.r2 = a.r2), m AS (SELECT min(align_score) AS alo, max(align_score) AS ahi FROM align_scores), n AS (SELECT min(score) AS clo, max(score) AS chi FROM pair_lengths) SELECT f AS fraction, r1, r2, round(f * (1 - (align_score - alo) / (ahi - alo)) + (1 - f) * (chain - clo) / (chi - clo), 6) AS value FROM s, m, n, (SELECT unnest([0.25, 0.5]::double[]) AS f)")
def q_blend_sweep(spark, d):
    out = jobs.blended_scores(view(spark, d, "align_scores"), view(spark, d, "pair_lengths").withColumnRenamed("score", "chain"), (0.25, 0.5))
    return out.select("fraction", "r1", "r2", *_r("value"))


@query("WITH prom AS (SELECT chrom, cast(CASE WHEN strand = '+' THEN greatest(0, start_pos - 201) ELSE stop_pos END AS int) AS start_pos, cast(CASE WHEN strand = '+' THEN start_pos - 1 ELSE stop_pos + 200 END AS int) AS stop_pos, gene FROM genes), sizes AS (SELECT chrom, count(*) AS k FROM regions GROUP BY 1), drawn AS (SELECT s.chrom AS cluster, r.acr, r.chrom, r.start_pos, r.stop_pos, k, row_number() OVER (PARTITION BY s.chrom ORDER BY substr(md5(concat(s.chrom, '/', r.acr, '/3')), 1, 8), r.acr) AS place FROM sizes s, regions r), g AS (SELECT DISTINCT d.cluster, p.gene FROM drawn d LEFT JOIN prom p ON p.chrom = d.chrom AND d.start_pos < p.stop_pos AND p.start_pos < d.stop_pos WHERE place <= k) SELECT cluster, coalesce(string_agg(gene, ',' ORDER BY gene), '') AS genes FROM g GROUP BY 1")
def q_random_gene_sets(spark, d):
    regions = view(spark, d, "regions")
    clustered = regions.select(F.col("acr").alias("id"), F.col("chrom").alias("cluster"))
    out = jobs.random_gene_sets(clustered, regions.select("acr"), genes.region_genes(regions, _promoters(spark, d)), 3)
    return out.select("cluster", F.array_join("genes", ",").alias("genes"))


@query(f"WITH alike AS ({LIKE}), m AS (SELECT DISTINCT motif1 AS id FROM alike), cells AS (SELECT a.id, b.id AS col, coalesce(s.similarity, -2) AS v FROM m a CROSS JOIN m b LEFT JOIN alike s ON s.motif1 = a.id AND s.motif2 = b.id), pairs AS (SELECT x.id AS id1, y.id AS id2, 1 - corr(x.v, y.v) AS distance FROM cells x JOIN cells y ON x.col = y.col AND x.id < y.id GROUP BY 1, 2) SELECT id1, id2, round(distance, 6) AS distance FROM pairs WHERE distance < 0.4")
def q_motif_distances(spark, d):
    return jobs.motif_distances(_similar(spark, d), 0.4).select("id1", "id2", *_r("distance"))


ALIKE = f"alike AS ({LIKE}), m AS (SELECT DISTINCT motif1 AS id FROM alike), names AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM m), cells AS (SELECT a.k, b.id AS col, coalesce(s.similarity, -2) AS v FROM names a CROSS JOIN m b LEFT JOIN alike s ON s.motif1 = a.id AND s.motif2 = b.id), t AS MATERIALIZED (SELECT x.k AS i, y.k AS j, greatest(0.0, 1 - corr(x.v, y.v)) AS x FROM cells x JOIN cells y ON x.col = y.col AND x.k < y.k GROUP BY x.k, y.k HAVING 1 - corr(x.v, y.v) <= 0.4)"


@query(_linkage(ALIKE, "names", "CASE WHEN n < np THEN greatest(m, 2.0) ELSE m END", "<= 0.4"))
def q_tomtom_clusters(spark, d):
    return jobs.motif_similarity_clusters(_similar(spark, d), 0.4)


@query(f"""WITH {RANKED}, v AS (SELECT cast(k AS int) AS rank, "group", score FROM ranked WHERE k <= 3 AND score <> 0), b AS (SELECT rank, "group", count(*) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM v GROUP BY 1, 2)
SELECT b.rank, b."group", cast(b.n AS bigint) AS n, min(score) AS low, b.q1, b.median, b.q3, max(score) AS high FROM b JOIN v ON v.rank = b.rank AND v."group" = b."group" AND v.score BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1) GROUP BY ALL""")
def q_rank_boxes(spark, d):
    return jobs.rank_boxes(jobs.rank_frequencies(view(spark, d, "pair_lengths"), view(spark, d, "reference"), 1000, RankOptions(ranks=(1, 2, 3))))


@query(f'WITH {FEATURES} SELECT "group", cast(count(*) AS bigint) AS n, quantile_cont(chain_num, 0.25) AS q1, quantile_cont(chain_num, 0.5) AS median, quantile_cont(chain_num, 0.75) AS q3 FROM features GROUP BY 1')
def q_count_boxes(spark, d):
    freq = jobs.feature_frequencies(view(spark, d, "pair_lengths"), view(spark, d, "reference"), RankOptions(lengths=(), fractions=()))
    return jobs.feature_boxes(freq, "count").select("group", "n", "q1", "median", "q3")


@query(f"WITH RECURSIVE {DIST}, e AS (SELECT id1 AS a, id2 AS b FROM dist WHERE distance < 0.9 UNION SELECT id2, id1 FROM dist WHERE distance < 0.9), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a")
def q_components(spark, d):
    return components(_distances(spark, d).where("distance < 0.9").select(F.col("id1").alias("a"), F.col("id2").alias("b")))
