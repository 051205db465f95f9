"""Literal files of the published formats, with the line ends of either system, plain and compressed."""

import gzip

import pytest

from colinear.sources import readers

FIMO = "motif_id\tmotif_alt_id\tsequence_name\tstart\tstop\tstrand\tscore\n1-AC\t.\tChr1_1to90\t5\t9\t+\t3.1\n1-AC\t.\tChr1_1to90\t5\t9\t-\t2.0\n2-GG\t.\tChr1_1to90\t7\t12\t+\t1.5\n\n# FIMO (Find Individual Motif Occurrences): Version 5.5.0\n# fimo --oc out a.meme b.fa\n"
MEME = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nMOTIF m1 alt\nletter-probability matrix: alength= 4 w= 2 nsites= 20 E= 0\n 0.25 0.25 0.5 0\n 1.0 0 0 0\nURL http://x.org/m1\n\nMOTIF m2\nletter-probability matrix: alength= 4 w= 1\n0 1e-1 0.9 0\n"
GFF = "##gff-version 3\nChr1\tT\tgene\t10\t90\t.\t+\t.\tID=g1;Name=a\nChr1\tT\tmRNA\t10\t90\t.\t+\t.\tID=g1.1;Parent=g1\nshort\tline\n###\n"
HITS = "k=4\tmultiplier=1.2\nACR\tScore\tChromosome\tStart\tStop\tAlignment Score\na\t45.0\tChr1\t1\t9\t0.25\nb\t21\tChr2\t3\t8\t\n"
CASES = {
    "fimo_regions": (FIMO, lambda s, p: readers.fimo_regions(s, p), [("Chr1_1to90", "AC", 5), ("Chr1_1to90", "GG", 7)]),
    "fimo_genome": (FIMO, lambda s, p: readers.fimo_genome(s, p), [("1-AC", "Chr1_1to90", 5, 9), ("2-GG", "Chr1_1to90", 7, 12)]),
    "motif_blocks": ("ACR: a\nm1\nm2\n\nACR: empty\nACR: c\nm1", lambda s, p: readers.motif_blocks(s, p), [("a", ["m1", "m2"]), ("c", ["m1"]), ("empty", [])]),
    "fasta": (">Chr1 of x\nACGT\nAC\n\n>Chr2\n>Chr3\nGG", lambda s, p: readers.fasta(s, p), [("Chr1", "ACGTAC"), ("Chr2", ""), ("Chr3", "GG")]),
    "fasta_lines": (">Chr1 of x\nACGT\nAC\n\n>Chr2\n>Chr3\nGG", lambda s, p: readers.fasta_lines(s, p).where("bases <> ''"), [("Chr1", 0, "ACGT"), ("Chr1", 4, "AC"), ("Chr3", 0, "GG")]),
    "fasta_names": (">Chr1_1to9 x\nAC\n>Chr2_3to8_rand\nGG\n", lambda s, p: readers.fasta_names(s, p), [("Chr1_1to9 x",), ("Chr2_3to8_rand",)]),
    "region_list": ("Chr1_9to3\n\nChr1_9to3\nChr2_1to100_rand\n", lambda s, p: readers.region_list(s, p, 1, 10).select("acr", "start_pos", "stop_pos"), [("Chr1_9to3", 3, 9)]),
    "pair_table": ("b\ta\t1\na\tb\t2\na\tc\t0.5\n", lambda s, p: readers.pair_table(s, p), [("a", "b", 2.0), ("a", "c", 0.5)]),
    "motif_scores": ("motif\tscore\tacr\tfull\nm\t-1.5\t0.25\t0.5\n", lambda s, p: readers.motif_scores(s, p), [("m", -1.5, 0.25, 0.5)]),
    "motif_relevance": ("motif\ta\tb\tc\td\tz\nm\t3\t9\t0.5\t0.25\t-2.5\n", lambda s, p: readers.motif_relevance(s, p), [("m", 3, 9, 0.5, 0.25, -2.5)]),
    "motif_clusters": ("m1\tC1\nm2\tC1\n", lambda s, p: readers.motif_clusters(s, p), [("m1", "C1"), ("m2", "C1")]),
    "meme": (MEME, lambda s, p: readers.meme(s, p), [("m1", [[0.25, 0.25, 0.5, 0.0], [1.0, 0.0, 0.0, 0.0]]), ("m2", [[0.0, 0.1, 0.9, 0.0]])]),
    "tomtom": ("Query_ID\tTarget_ID\tOptimal_offset\tp-value\tE-value\na\tb\t0\t0.1\t0.5\nb\ta\t0\t0.1\t1e-9\n\n# Tomtom (Motif Comparison Tool)\n", lambda s, p: readers.tomtom(s, p), [("a", "b", 0.5), ("b", "a", 1e-9)]),
    "gff": (GFF, lambda s, p: readers.gff(s, p).select("chrom", "feature", "start_pos", "stop_pos", "attrs"), [("Chr1", "gene", 10, 90, "ID=g1;Name=a"), ("Chr1", "mRNA", 10, 90, "ID=g1.1;Parent=g1")]),
    "region_gene_overlaps": ("Chr1\t1\t9\ta\tChr1\t5\t20\tg\t0\t-\n", lambda s, p: readers.region_gene_overlaps(s, p), [("a", 1, 9, "g", 5, 20, "-")]),
    "bed": ("Chr1\t1\t9\ta\t0\t+\n", lambda s, p: readers.bed(s, p), [("Chr1", 1, 9, "a", "0", "+")]),
    "cluster_file": ("Cluster no: 3, Representative: a\na\tb\t\nCluster no: 4, Representative: c\nc\n", lambda s, p: readers.cluster_file(s, p), [(3, "a", ["a", "b"]), (4, "c", ["c"])]),
    "gene_set_file": ("Cluster 1\ng1\tg2\nCluster 2\n\n", lambda s, p: readers.gene_set_file(s, p), [("Cluster 1", ["g1", "g2"]), ("Cluster 2", [])]),
    "frequency_file": ("1.5\t3\nx\n", lambda s, p: readers.frequency_file(s, p), [(1.5, 3)]),
    "search_hits": (HITS, lambda s, p: readers.search_hits(s, p, least=20), [("a", 45.0, "Chr1", 1, 9, 0.25), ("b", 21.0, "Chr2", 3, 8, None)]),
    "ncbi_hits": ("\t".join(["Chr1", *"12345", "9", "3", "1", "1", "1e-5", "50"]) + "\n", lambda s, p: readers.search_hits(s, p, "ncbi", 1e-3), [(None, 1e-5, "Chr1", 3, 9, None)]),
}


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_literal_files(spark, tmp_path, end, packed):
    for name, (text, read, want) in CASES.items():
        data = text.replace("\n", end).encode()
        path = tmp_path / (f"{name}.txt.gz" if packed else f"{name}.txt")
        path.write_bytes(gzip.compress(data) if packed else data)
        assert sorted(map(tuple, read(spark, str(path)).collect()), key=str) == sorted(want, key=str), name
    folder = tmp_path / "chromosomes"
    folder.mkdir()
    for chrom, text in (("Chr1", "m\t1\t5\nBREAK\nn\t9000\t9005\n"), ("Chr2", "m\t3\t8\n")):
        data = text.replace("\n", end).encode()
        (folder / f"{chrom}.tsv{'.gz' if packed else ''}").write_bytes(gzip.compress(data) if packed else data)
    got = sorted((r.chrom, r.idx, r.motif, r.start_pos, r.stop_pos) for r in readers.chromosome_motifs(spark, str(folder)).collect())
    assert got == [("Chr1", 0, "m", 1, 5), ("Chr1", 1, "n", 9000, 9005), ("Chr2", 0, "m", 3, 8)]


def test_lines_in_turn(spark, tmp_path):
    from colinear.format_queries import _in_turn

    rows = spark.createDataFrame([(str(k), k) for k in [1] * 30 + [0] * 30 + [2] * 300], "value string, k int").coalesce(1)
    _in_turn(rows, str(tmp_path / "lines"))
    for part in (tmp_path / "lines").glob("part-*"):
        lines = part.read_text().split()
        assert lines == sorted(lines)
