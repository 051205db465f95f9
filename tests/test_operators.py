import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from colinear.functions import kernels
from colinear.functions import regions as rg
from colinear.functions import scores as sc
from colinear.operators import chains, clustering, genes, intervals, occurrences, sampling, search, weights
from colinear.operators import statistics as st
from colinear.operators.components import components
from colinear.plans import jobs
from colinear.plans.options import ChainOptions, ClusterOptions, RankOptions
from colinear.sources import readers, writers
from colinear.streaming.incremental import chain_arrivals


def occ_rows(seed=1, regions=8, n=9, motifs=5):
    r = random.Random(seed)
    return [(f"Chr1_{i * 100 + 1}to{i * 100 + 80}{'_rand' if i % 3 == 0 else ''}", p, f"m{r.randrange(motifs)}") for i in range(regions) for p in range(n)]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_formulas(spark):
    lit = F.lit
    assert value(spark, sc.two_proportion_z(lit(0), lit(10), lit(0), lit(10))) == 0
    assert value(spark, sc.global_distance(lit(10), lit(4), lit(10), 0.0, 0.2)) == pytest.approx(0.5)
    assert value(spark, sc.global_distance(lit(10), lit(0), lit(0), 0.5, 1)) == 1
    assert value(spark, sc.local_distance(lit(0.0), 3)) is None
    assert value(spark, sc.consensus_letters(F.array(F.array(*map(lit, (0.1, 0.7, 0.1, 0.1))), F.array(*map(lit, (0.4, 0.4, 0.1, 0.1)))))) == "CA"
    assert value(spark, sc.gff_attribute(lit("ID=a;Parent=AT1.2"), "Parent")) == "AT1"
    assert value(spark, sc.evalue_similarity(lit(0.0))) == 10 and value(spark, sc.evalue_similarity(lit(None).cast("double"))) == -2
    assert value(spark, sc.rounded(lit(2.5))) == 2
    assert value(spark, sc.sub_sequence(lit("ACGTA"), lit(2), lit(4), lit(True), True)) == "ACG"
    with pytest.raises(Exception, match="positive"):
        value(spark, sc.match_score(lit(0.0), lit(0.5), 0))
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "motif string, score double")
    assert {r.motif: r.score for r in weights.centred_scores(rows, 5).collect()} == {"a": 2.5, "b": 7.5}


@pytest.mark.parametrize(("block", "held"), [(128, 2_000_000), (3, 20)])
def test_chains_against_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(chains, "BLOCK", block)
    monkeypatch.setattr(chains, "HELD", held)
    rows = occ_rows()
    occ = spark.createDataFrame(rows, "acr string, pos int, motif string")
    w = {f"m{i}": i - 1.0 for i in range(5)}
    scores = spark.createDataFrame(list(w.items()), "motif string, score double")
    acrs = sorted({r[0] for r in rows})
    pairs = {(x, y): [(p, q, m) for a, p, m in rows if a == x for b, q, m2 in rows if b == y and m2 == m] for x in acrs for y in acrs if x < y}
    got = {(r.acr1, r.acr2): r for r in chains.global_chains(occ).collect()}
    native = {(r.acr1, r.acr2): (r.chain, r.n_anchors) for r in chains.native_global_chains(occ).collect()}
    heavy = {(r.acr1, r.acr2): r.chain for r in chains.global_chains(occ, weights=scores).collect()}
    local = {(r.acr1, r.acr2): (r.score, r.chain_len) for r in chains.local_chains(occ, weights=scores).collect()}
    assert set(got) == {p for p, v in pairs.items() if v}
    for p, v in pairs.items():
        if v:
            a, c = [x[0] for x in v], [x[1] for x in v]
            both = (c, [-x for x in c])
            assert got[p].chain == max(kernels.chain_length(a, y) for y in both) and got[p].n_anchors == len(v)
            assert native[p] == (got[p].chain, len(v))
            assert heavy[p] == max(kernels.chain_weight(a, y, [w[x[2]] for x in v]) for y in both)
            assert local[p] == max(kernels.local_chain(a, y, [w[x[2]] for x in v], -1, -1) for y in both)
    with pytest.raises(Exception, match="no weight"):
        chains.global_chains(occ, weights=scores.where("motif <> 'm1'")).collect()
    assert {(r.acr1, r.acr2): r.score for r in chains.local_chains(occ, weights=scores, lengths=False).collect()} == {p: v[0] for p, v in local.items()}
    offsets = chains.anchor_offsets(chains.anchor_counts(occ)).collect()
    ends = sorted((r["first"], r["stop"]) for r in offsets)
    assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    assert chains.global_chains(occ.where("1 = 0")).count() == 0
    other = occ.selectExpr("concat('x', acr) AS acr", "pos", "motif")
    two = {(r.acr1, r.acr2[1:]): r.chain for r in chains.global_chains(occ, other).collect()}
    assert len(two) > len(got) and all(two[p] == two[p[1], p[0]] == r.chain for p, r in got.items())
    nulls = occ.union(spark.createDataFrame([(None, 1, "m1"), (acrs[0], 1, None), (acrs[1], 1, None)], occ.schema))
    assert sorted(map(tuple, chains.global_chains(nulls).collect())) == sorted(map(tuple, got.values()))


def test_occurrences(spark):
    occ = spark.createDataFrame([("m", "c", s, s + 4) for s in (10, 14, 30)], "motif string, chrom string, start_pos int, stop_pos int")
    left = occurrences.without_self_overlaps(occ, ["motif", "chrom"], F.col("stop_pos") - F.col("start_pos"))
    assert sorted(r.start_pos for r in left.collect()) == [14, 30]
    regions = spark.createDataFrame([("a", "c", 100, 200), ("b", "c", 150, 160)], "acr string, chrom string, start_pos int, stop_pos int")
    hits = spark.createDataFrame([("m", "c", 155, 170), ("m", "c", 110, 120), ("m", "d", 110, 120), ("n", "c", 151, 160)], "motif string, chrom string, start_pos int, stop_pos int")
    for bucket in (1, 7, 64, 1 << 20):
        assert sorted((r.start_pos, r.acr) for r in occurrences.within_regions(hits, regions, bucket).collect()) == [(110, "a"), (151, "b")]
    breaks = occurrences.with_breaks(occ, 16)
    assert [r.break_before for r in breaks.orderBy("start_pos").collect()] == [False, False, True]


def test_rows_without_group_or_start_stay(spark):
    rows = [("m", "Chr1", 5, 9), ("m", "Chr1", None, 9), ("m", None, 7, 9), ("k", None, 3, 9), ("m", "Chr1", 3_000_000, 3_000_009)]
    occ = spark.createDataFrame(rows, "motif string, chrom string, start_pos int, stop_pos int")
    got = {(r.chrom, r.start_pos): r.idx for r in occurrences.indexed(occ).collect()}
    assert got == {("Chr1", None): 0, ("Chr1", 5): 1, ("Chr1", 3_000_000): 2, (None, 3): 0, (None, 7): 1}
    assert occurrences.numbered(occ, "chrom").count() == 5
    assert {(r.chrom, r.start_pos): r.break_before for r in occurrences.with_breaks(occ, 100).collect()} == {("Chr1", None): False, ("Chr1", 5): False, ("Chr1", 3_000_000): True, (None, 3): False, (None, 7): False}
    assert intervals.union(occ.where("start_pos is not null")).count() == 3


def test_self_overlaps_over_stretches(spark):
    r = random.Random(3)
    size = occurrences.STRETCH
    starts = sorted({k * size + d for k in range(4) for d in [*range(-60, 60, 7), *(r.randrange(size) for _ in range(40))] if k * size + d >= 0})
    rows = [(m, "Chr1", x, x + r.randrange(3, 40)) for m in "ab" for x in starts] + [("a", "Chr1", None, 5)]
    df = spark.createDataFrame(rows, "motif string, chrom string, start_pos int, stop_pos int")
    want = {("a", None)}
    for m in "ab":
        own = sorted((x, e) for k, _, x, e in rows if k == m and x is not None)
        want |= {(m, x) for i, (x, e) in enumerate(own) if i + 1 == len(own) or own[i + 1][0] - x > e - x}
    got = {(x.motif, x.start_pos) for x in occurrences.without_self_overlaps(df, ["motif", "chrom"], F.col("stop_pos") - F.col("start_pos")).collect()}
    assert got == want and len(got) < len(rows)
    with pytest.raises(Exception, match="of over"):
        occurrences.without_self_overlaps(df, ["motif", "chrom"], F.lit(10**6)).count()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 520)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intervals(spark):
    make = lambda rows: spark.createDataFrame(rows, "chrom string, start_pos int, stop_pos int")
    one = make([("c", 1, 5), ("c", 3, 8), ("c", 10, 10), ("d", 6, 9), ("d", 1, 5)])
    assert sorted(map(tuple, intervals.union(one).collect())) == [("c", 1, 8), ("c", 10, 10), ("d", 1, 5), ("d", 6, 9)]
    assert sorted(map(tuple, intervals.union(one, True).collect())) == [("c", 1, 8), ("c", 10, 10), ("d", 1, 9)]
    r = random.Random(5)
    a, b = ([("c", s, s + r.randrange(30)) for s in (r.randrange(400) for _ in range(25))] for _ in range(2))
    bases = lambda rows: {p for _, s, e in rows for p in range(s, e + 1)}
    assert bases(map(tuple, intervals.difference(make(a), make(b)).collect())) == bases(a) - bases(b)
    regions = spark.createDataFrame([(f"r{i}", *x) for i, x in enumerate(a)], "acr string, chrom string, start_pos int, stop_pos int")
    for size in (8, 4096):
        covered = {x.acr: x.covered for x in intervals.coverage(regions, make(b), size).collect()}
        assert covered == {f"r{i}": len(bases([x]) & bases(b)) for i, x in enumerate(a)}


def test_search_extends_a_planted_copy(spark):
    motifs = [f"m{i % 11}{i % 7}" for i in range(60)]
    genome = spark.createDataFrame([("c", i, m, i * 10, i * 10 + 5) for i, m in enumerate(motifs)], "chrom string, idx int, motif string, start_pos int, stop_pos int")
    regions = spark.createDataFrame([("Chr1_1to9", motifs[20:30]), ("Chr1_20to30", ["x"] * 6)], "acr string, motifs array<string>")
    hits = search.extended(search.seeds(regions, genome), regions, genome).collect()
    assert {(r.acr, r.score, r.start_pos, r.stop_pos) for r in hits} == {("Chr1_1to9", 50.0, 200, 295)}
    assert jobs.genome_search(regions, genome).count() >= 1


@pytest.mark.parametrize("average", [True, False])
@pytest.mark.parametrize("tied", [True, False])
def test_clusters_equal_whole_linkage(spark, average, tied):
    import numpy as np

    r = random.Random(11 + average)
    n = 24
    grid, rows = np.full((n, n), 1.0), []
    for i in range(n):
        for j in range(i):
            if r.random() < 0.35:
                grid[i, j] = grid[j, i] = x = r.choice([0.125, 0.25, 0.375, 0.5, 0.625, 0.75]) + (0 if tied else r.random() / 1000)
                rows.append((j, i, x) if r.random() < 0.5 else (i, j, x))
    want = kernels.linkage_clusters(grid, 0.8, average)
    rows += [(3, 3, 0.0)]
    distances, ids = spark.createDataFrame(rows, "id1 long, id2 long, distance double"), spark.range(n)
    for finish in (0, 40, 10_000):  # all in rounds, some, none
        got = {x.id: x.cluster for x in clustering.clusters(distances, 0.8, ids, average, finish=finish).collect()}
        assert got == dict(enumerate(want))
    named = distances.selectExpr("concat('n', lpad(id1, 2, '0')) AS id1", "concat('n', lpad(id2, 2, '0')) AS id2", "distance")
    got = {x.id: x.cluster for x in clustering.clusters(named, 0.8, average=average, finish=0).collect()}
    assert all(c == f"n{want[int(i[1:])]:02}" for i, c in got.items())
    assert clustering.clusters(distances.where("false"), 0.8, ids).where("id <> cluster").count() == 0


def test_vector_distances_pack_blocks_once(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(60, 24))
    x[7], x[8] = x[3], x[3] + 1e-9 * r.normal(size=24)
    x[9] = 2.0
    unit = x - x.mean(1, keepdims=True)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    far = 1 - unit @ unit.T
    names = [f"v{i:02}" for i in range(60)]
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "id string, x array<double>")
    for below, block in ((0.7, 13), (0.7, 1000), (1.6, 25), (far[0, 1] + 1e-9, 7), (far[0, 1] - 1e-9, 7)):
        near = clustering.vector_distances(vectors, float(below), block)
        assert "collect_list" not in near._jdf.queryExecution().toString()  # blocks are packed as numbers, no rows go into every pair of blocks
        got = {(q.id1, q.id2): q.distance for q in near.collect()}
        want = {(names[i], names[j]): max(0.0, far[i, j]) for i in range(60) for j in range(i + 1, 60) if far[i, j] < below}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert clustering.vector_distances(vectors.where("false"), 0.7).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        clustering.vector_distances(vectors.union(spark.createDataFrame([("w", [1.0])], "id string, x array<double>")), 0.7).count()


def test_consensus(spark):
    rows = [(1, "a", list("abcdef"), True), (1, "b", list("abXcdef"), False), (1, "c", list("fedcba"), False), (2, "d", list("ab"), True)]
    out = clustering.star_consensus(spark.createDataFrame(rows, "cluster int, id string, motifs array<string>, is_center boolean")).collect()
    assert [(r.cluster, r.tokens) for r in out] == [(1, list("abcdef"))]
    m = spark.createDataFrame([(1, "x", [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]), (1, "y", [[1.0, 0.0, 0.0, 0.0]])], "cluster int, motif string, pssm array<array<double>>")
    assert clustering.consensus_matrices(m).first().pssm == [[1, 0, 0, 0], [0, 1, 0, 0]]
    assert clustering.evalue_table(spark.createDataFrame([("a", "b", 1e-3), ("b", "a", float("nan")), ("a", "c", 0.0)], "query string, target string, evalue double")).where("motif1 = 'b'").first().similarity == pytest.approx(3)


def star_brute(members, least, weight, mismatch=-1.0, gap=-1.0):
    """Consensus by one member after another, in plain Python: (cluster, id, motifs, is_center) rows."""
    from collections import Counter

    out = {}
    for cluster in {m[0] for m in members}:
        own = sorted((m for m in members if m[0] == cluster), key=lambda m: (not m[3], m[1]))
        center, cells = own[0][2], Counter()
        for *_, motifs, _ in own:
            pairs = [(i, j, weight(x)) for i, x in enumerate(center) for j, y in enumerate(motifs) if x == y]
            score = [kernels.local_chain([p[0] for p in pairs], [s * p[1] for p in pairs], [p[2] for p in pairs], mismatch, gap)[0] for s in (1, -1)]
            top, low = kernels.global_alignment(center, motifs[::-1] if score[1] > score[0] else motifs, mismatch=mismatch, gap=gap, weight=weight)
            i = put = 0
            for x, y in zip(top, low):
                if x == "-":
                    cells[i, put, y] += 1
                    put += 1
                else:
                    if y != "-":
                        cells[i, 10**9, y] += 1
                    i, put = i + 1, 0
        tokens = [c[2] for c in sorted(c for c, k in cells.items() if 2 * k > len(own))]
        if len(tokens) >= least:
            out[cluster] = tokens
    return out


def test_star_consensus_equals_brute_force(spark):
    r = random.Random(12)
    w = {"a": 5.0, "b": 2.0, "c": 7.5, "d": 1.0}
    members = []
    for cluster in range(12):
        center = [r.choice("abcd") for _ in range(r.randrange(0, 14))]
        for k in range(r.randrange(1, 9)):
            own = [x for x in center if r.random() < 0.85]
            for _ in range(r.randrange(3)):
                own.insert(r.randrange(len(own) + 1), r.choice("abcd"))
            members.append((cluster, f"m{k}", own[::-1] if r.random() < 0.4 else own, k == 1))
    df = spark.createDataFrame(members, "cluster int, id string, motifs array<string>, is_center boolean")
    for least, weights in ((0, None), (3, w)):
        got = {x.cluster: x.tokens for x in clustering.star_consensus(df.repartition(3), least, weights).collect()}
        assert got == star_brute(members, least, (lambda t: w[t]) if weights else lambda t: 5.0)
    assert clustering.star_consensus(df.where("false")).count() == 0


def test_genes(spark):
    gff = spark.createDataFrame([("c", "gene", 3000, 4000, "+", "ID=g1", 0), ("c", "five_prime_UTR", 3100, 3200, "+", "Parent=g1.1", 1), ("c", "gene", 10, 500, "-", "ID=g2", 2)], "chrom string, feature string, start_pos int, stop_pos int, strand string, attrs string, line_no long")
    assert sorted((r.gene, r.start_pos, r.stop_pos) for r in genes.promoters(gff, 100).collect()) == [("g1", 2999, 3099), ("g2", 500, 600)]
    e = spark.createDataFrame([(g, x, c, v) for g, s in (("g1", 1), ("g2", -1), ("g3", 0)) for x in "AB" for c, v in enumerate([1.0 * s, 2.0 * s, 4.0 * s])], "gene string, experiment string, cond int, tpm double")
    sets = spark.createDataFrame([(1, ["g1", "g2", "g3"])], "cluster int, genes array<string>")
    assert [(r.cluster, r.r, r.n_pairs) for r in genes.set_correlations(sets, e).collect()] == [(1, pytest.approx(-1), 1)]


def test_statistics(spark):
    acrs = [f"Chr1_{i * 1000}to{i * 1000 + 500}{'_rand' if i % 4 == 3 else ''}" for i in range(12)]
    ref = {a for i, a in enumerate(acrs) if i % 2 == 0}
    r = random.Random(2)
    pairs = [(min(x, y), max(x, y), float(r.randrange(6)), r.randrange(9)) for i, x in enumerate(acrs) for y in acrs[:i] if r.random() < 0.8]
    want = {}
    for a, b, s, _ in pairs:
        ra, rb, fa, fb = a.endswith("_rand"), b.endswith("_rand"), a in ref, b in ref
        side = (a if fb else None) if ra else (b if rb or not fb else None) if fa else (a if fb else None)
        if side:
            want.setdefault(("rand" if side.endswith("_rand") else "acr", side), []).append(s)
    df = spark.createDataFrame(pairs, "r1 string, r2 string, score double, n_anchors int")
    known = spark.createDataFrame([(x,) for x in ref], "region string")
    scores = st.reference_scores(df, known)
    got = {}
    for x in scores.collect():
        got.setdefault((x.group, x.region), []).append(x.score)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    third = {(x.group, x.region): x.value for x in st.nth_highest(scores, 3, 6).collect()}
    assert third == {k: sorted(v + [0] * (6 - len(v)))[-3] for k, v in want.items()}
    padded = {(x.group, x.score): x.n for x in st.with_padding(scores, 6, 6).collect()}
    for g in ("acr", "rand"):
        full = [s for (k, _), v in want.items() if k == g for s in v + [0] * (6 - len(v))]
        full += [0] * (36 - len(full))
        assert {s: n for (k, s), n in padded.items() if k == g} == {s: full.count(s) for s in set(full)}
    assert jobs.rank_frequencies(df, known, 6, RankOptions(ranks=(1, 2))).groupBy("rank", "group").agg(F.sum("freq")).count() == 4
    assert jobs.feature_frequencies(df, known, RankOptions(lengths=(2, 3)), 2).count() > 0
    assert jobs.summary_frequencies(df, known, 6, 6).where("kind = 'max'").count() > 0
    assert jobs.banded_frequencies(df, known, RankOptions(bands=((400, 600), (600, 700)))).select("low").distinct().count() == 1
    assert jobs.normalised_rank_frequencies(df, known, 6, RankOptions(ranks=(1,))).where("value < 0 or value > 1").count() == 0
    four = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert st.nearest_rank(four, 50, "v").first().value == 3
    assert st.share_at_most(four, 0.5, "v").first().share == 0.5 and st.share_at_most(four, 1.0, "v", True).first().share == 0.25
    freq = spark.createDataFrame([("x", 0.5, 2), ("x", 1.5, 3), ("x", -4.0, 1), ("x", 99.0, 1)], "g string, value double, freq long")
    assert {(b.bin, b.n) for b in st.histogram(freq, ["g"], 5).collect()} == {(0, 2), (2, 3), (None, 2)}
    box = st.box_data(spark.createDataFrame([("x", float(v), 1) for v in (1, 2, 3, 4, 100)], "g string, value double, freq long"), ["g"]).first()
    assert (box.q1, box.median, box.q3, box.low, box.high) == (2, 3, 4, 1, 4)


def test_sampling(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(100)], "key string")
    assert sorted(r.key for r in sampling.split_fraction(df, "key", 0.1).where("in_first").collect()) == [f"k{i:03}" for i in range(10)]
    assert sampling.split_fraction(df, "key", 0.25, 1).where("in_first").count() == 25
    sizes = spark.createDataFrame([("a", 3), ("b", 100), ("c", 0)], "g string, k int")
    got = sampling.sample_per_group(df, sizes, "g", "key", 1)
    assert {(r.g, r.n) for r in got.groupBy("g").agg(F.countDistinct("key").alias("n")).collect()} == {("a", 3), ("b", 100)}
    lengths = spark.createDataFrame([("Chr1", 500, 0), ("Chr2", 900, 1)], "chrom string, length int, rank int")
    for r in sampling.random_regions(spark, lengths, 50, 10, 40, 1).collect():
        assert 10 <= r.stop_pos - r.start_pos + 1 <= 40 and 1 <= r.start_pos and r.stop_pos <= {"Chr1": 500, "Chr2": 900}[r.chrom] and r.acr.endswith("_rand")


def test_text_formats(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    path = put("f.tsv", "motif_id\talt\tseq\tstart\tstop\n1-AC\t.\tChr1_1to90\t5\t9\n1-AC\t.\tChr1_1to90\t5\t9\n2-GG\t.\tChr1_1to90\t7\t9\n\n# comment line\n")
    assert sorted(map(tuple, readers.fimo_regions(spark, path).collect())) == [("Chr1_1to90", "AC", 5), ("Chr1_1to90", "GG", 7)]
    assert readers.fimo_genome(spark, path).count() == 2
    blocks = put("b.txt", "ACR: a\nm1\nm2\nACR: empty\nACR: c\nm1\n")
    seqs = readers.motif_blocks(spark, blocks)
    assert {r.acr: r.motifs for r in seqs.collect()} == {"a": ["m1", "m2"], "empty": [], "c": ["m1"]}
    writers.motif_blocks(seqs, str(tmp_path / "blocks"))
    assert sorted(map(str, readers.motif_blocks(spark, str(tmp_path / "blocks")).collect())) == sorted(map(str, seqs.collect()))
    assert readers.two_sets(spark, blocks, blocks).groupBy("side").count().count() == 2
    fa = put("g.fa", ">Chr1 x\nACGT\nAC\n>Chr2\nGG\n")
    assert {r.id: r.seq for r in readers.fasta(spark, fa).collect()} == {"Chr1": "ACGTAC", "Chr2": "GG"}
    writers.fasta(readers.fasta(spark, fa), str(tmp_path / "fa"), files=2)
    assert readers.chromosome_lengths(spark, str(tmp_path / "fa"), ["Chr1"]).first().length == 6
    assert {r.region for r in readers.fasta_names(spark, fa).collect()} == {"Chr1 x", "Chr2"}
    gff = put("x.gff", "#c\nChr1\tT\tgene\t1\t9\t.\t+\t.\tID=a\nshort\tline\n")
    assert [r.start_pos for r in readers.gff(spark, gff).collect()] == [1]
    meme = spark.createDataFrame([("m1", [[0.25, 0.25, 0.5, 0.0]]), ("m2", [[1.0, 0.0, 0.0, 0.0]])], "motif string, pssm array<array<double>>")
    writers.meme(meme, str(tmp_path / "meme"))
    assert {r.motif: r.pssm for r in readers.meme(spark, str(tmp_path / "meme")).collect()} == {r.motif: r.pssm for r in meme.collect()}
    cl = spark.createDataFrame([(3, "a", ["a", "b"])], "cluster int, representative string, members array<string>")
    writers.cluster_file(cl, str(tmp_path / "cl"))
    assert readers.cluster_file(spark, str(tmp_path / "cl")).collect() == cl.collect()
    gs = spark.createDataFrame([("Cluster 1", ["g1", "g2"])], "cluster string, genes array<string>")
    writers.gene_set_file(gs, str(tmp_path / "gs"))
    assert readers.gene_set_file(spark, str(tmp_path / "gs")).collect() == gs.collect()
    occ = occurrences.with_breaks(spark.createDataFrame([("m", "Chr1", 1, 2), ("n", "Chr1", 9000, 9001), ("m", "Chr2", 3, 4)], "motif string, chrom string, start_pos int, stop_pos int"))
    writers.chromosome_motifs(occ, str(tmp_path / "chr"))
    assert sorted((r.chrom, r.idx, r.motif) for r in readers.chromosome_motifs(spark, str(tmp_path / "chr")).collect()) == [("Chr1", 0, "m"), ("Chr1", 1, "n"), ("Chr2", 0, "m")]
    assert readers.chromosome_motifs(spark, str(tmp_path / "chr"), keep_breaks=True).where("is_break").count() == 1
    hits = put("h.tsv", "params\nACR\tScore\tChr\tStart\tStop\na\t4.5\tChr1\t1\t9\nb\t1.0\tChr2\t1\t9\n")
    assert [r.acr for r in readers.search_hits(spark, hits, least=2).collect()] == ["a"]
    ncbi = put("n.tsv", "\t".join(["Chr1", *"12345", "9", "3", "1", "1", "1e-5", "50"]) + "\n")
    assert [(r.start_pos, r.stop_pos) for r in readers.search_hits(spark, ncbi, "ncbi", 1e-3).collect()] == [(3, 9)]
    pairs = put("p.tsv", "b\ta\t1\na\tb\t2\n")
    assert [tuple(r) for r in readers.pair_table(spark, pairs).collect()] == [("a", "b", 2.0)]
    assert readers.region_list(spark, put("r.txt", "Chr1_9to3\n\nChr2_1to100_rand\n"), 1, 10).first().start_pos == 3
    assert readers.frequency_file(spark, put("q.tsv", "1.5\t3\nx\n")).count() == 1
    tom = put("t.tsv", "Query ID\tTarget ID\tE-value\na\tb\t0.5\n")
    assert readers.tomtom(spark, tom).first().evalue == 0.5
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("expA/x_tpms.tsv", "gene\tn\tc1\tc2\nG1\t.\t1.0,3.0\t5\n")
        z.writestr("expA/other.tsv", "no")
    assert [(r.gene, r.experiment, r.cond, r.tpm) for r in readers.expression_zip(spark, str(tmp_path / "e.zip")).orderBy("cond").collect()] == [("G1", "expA", 0, 2.0), ("G1", "expA", 1, 5.0)]


def test_jobs_and_stream(spark, tmp_path):
    occ = spark.createDataFrame(occ_rows(), "acr string, pos int, motif string")
    chained = jobs.pairwise_chains(occ)
    clustered, reps = jobs.region_clusters(chained, occurrences.sequences(occ), ClusterOptions(threshold=0.9, more_than=1))
    assert clustered.count() == 8 and reps.count() >= 1
    jobs.cluster_consensus(clustered, reps, occurrences.sequences(occ), options=ClusterOptions(least_consensus=1)).count()
    known, new = occ.where("acr not like '%_rand'"), occ.where("acr like '%_rand'")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    chain_arrivals(stream, known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.pairwise_chains(new, known).collect()))
    assert jobs.pairwise_chains(occ, options=ChainOptions(local=True)).count() == chained.count()


def test_alignment_timer():
    from colinear.plans.timing import alignment_seconds

    seconds, score = alignment_seconds(60, seed=3)
    assert seconds > 0 and score == alignment_seconds(60, seed=3)[1] and alignment_seconds(60, True)[1] >= alignment_seconds(60)[1]


def test_fasta_in_blocks(spark, tmp_path):
    r = random.Random(4)
    known = {f"Chr{k}": "".join(r.choice("ACGT") for _ in range(r.choice((0, 1, 59, 60, 700)))) for k in range(9)}
    (tmp_path / "fa").mkdir()
    for part in range(2):
        text = "stray line\r\n"
        for name, seq in list(known.items())[part::2]:
            text += f">{name} note\r\n" + "".join(seq[i : i + 60] + "\r\n" for i in range(0, len(seq), 60)) + "\n"
        (tmp_path / "fa" / f"{part}.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")  # splits begin within sequences and within lines
    try:
        lines = readers.fasta_lines(spark, str(tmp_path / "fa")).collect()
        blocks = readers.fasta_blocks(spark, str(tmp_path / "fa"), size=128)
        got = sorted(map(tuple, blocks.collect()))
        lengths = {x.chrom: x.length for x in readers.chromosome_lengths(spark, str(tmp_path / "fa")).collect()}
        some = {x.chrom for x in readers.fasta_blocks(spark, str(tmp_path / "fa"), ["Chr3"]).collect()}
        regions = spark.createDataFrame([(name, 100, 300) for name in known], "chrom string, start_pos int, stop_pos int")
        cut = {x.chrom: x.seq for x in intervals.sliced(regions, blocks, size=128).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(known[x.id][x["at"] : x["at"] + len(x.bases)] == x.bases for x in lines)
    assert got == sorted((name, b, seq[b * 128 : (b + 1) * 128]) for name, seq in known.items() for b in range(-(-len(seq) // 128)))
    assert lengths == {name: len(seq) for name, seq in known.items()} and some == {"Chr3"} - ({"Chr3"} if not known["Chr3"] else set())
    assert all(cut.get(name, "") == seq[99:300] for name, seq in known.items())
    writers.fasta(spark.createDataFrame(list(known.items()), "id string, seq string"), str(tmp_path / "out"), width=60)
    assert {x.id: x.seq for x in readers.fasta(spark, str(tmp_path / "out")).collect()} == known


@pytest.mark.parametrize("block, held, counted", [(128, 2_000_000, 1 << 18), (3, 7, 5)])
def test_counts_by_blocks_equal_brute_force(spark, monkeypatch, block, held, counted):
    monkeypatch.setattr(chains, "BLOCK", block)
    monkeypatch.setattr(chains, "HELD", held)
    monkeypatch.setattr(chains, "COUNTED", counted)
    rnd = random.Random(4)
    for kinds in (3, 400):  # by a matrix product, and by the meetings
        seqs = {f"r{k}{'_rand' if k % 3 == 0 else ''}": [f"m{rnd.randrange(kinds)}" for _ in range(rnd.randrange(9))] for k in range(23)}
        occ = spark.createDataFrame([(a, p, m) for a, s in seqs.items() for p, m in enumerate(s)] + [(None, 0, "m1"), ("r1", 99, None)], "acr string, pos int, motif string")
        times = lambda a, b: sum(seqs[a].count(m) * seqs[b].count(m) for m in set(seqs[a]))
        shared = lambda a, b: len(set(seqs[a]) & set(seqs[b]))
        one = [(a, b) for a in seqs for b in seqs if a < b and shared(a, b)]
        two = [(a, b) for a in seqs for b in seqs if a.endswith("_rand") and not b.endswith("_rand") and shared(a, b)]
        sides = occ.where("acr like '%_rand'"), occ.where("acr not like '%_rand'")
        for found, f in ((chains.anchor_counts, times), (chains.motif_counts, shared)):
            assert sorted(map(tuple, found(occ).collect())) == sorted((a, b, f(a, b)) for a, b in one)
            assert sorted(map(tuple, found(*sides).collect())) == sorted((a, b, f(a, b)) for a, b in two)


def test_pairs_stay_where_they_are(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 2, 3), ("a_rand", "b", 4.0, 1, 9)], "r1 string, r2 string, score double, n_anchors int, ref_len int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = st.reference_scores(pairs, spark.createDataFrame([("b",)], "region string"))
        lengths = spark.createDataFrame([("a", 2), ("b", 3)], "acr string, n_motifs int")
        distances = clustering.chain_distances(pairs.selectExpr("r1 as acr1", "r2 as acr2", "score as chain"), lengths)
        medoids = clustering.medoids(spark.createDataFrame([("a", "x"), ("b", "x")], "id string, cluster string"), spark.createDataFrame([("a", "b", 0.5)], "id1 string, id2 string, distance double"))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        for df in (scores, distances):
            assert "Exchange hashpartitioning" not in plan(df) and "SortMergeJoin" not in plan(df)
        assert plan(medoids).count("SortMergeJoin") <= 2  # over regions, not pairs
        assert "WindowGroupLimit" not in plan(st.nth_highest(scores, 2))  # no sort of all pairs
        assert plan(st.nth_features(scores, 1)).count("SortMergeJoin") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sample_of_a_group_that_takes_most_rows(spark):
    keys = [f"k{i}" for i in range(500)]
    sizes = spark.createDataFrame([("a", 480), ("b", 0), ("c", 900), (None, 3), ("d", 7)], "g string, k int")
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {}
    for r in sampling.sample_per_group(df, sizes.where("g is not null"), "g", "key", 3).collect():
        got.setdefault(r.g, []).append(r.key)
    order = lambda g: sorted(keys, key=lambda k: (hashlib.md5(f"{g}/{k}/3".encode()).hexdigest()[:8], k))
    assert {g: sorted(v) for g, v in got.items()} == {"a": sorted(order("a")[:480]), "c": sorted(keys), "d": sorted(order("d")[:7])}
    rows = sampling.sample_per_group(df, sizes.where("g is not null"), "g", "key", 3)
    windows = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in line]
    assert windows and all("_s#" in line for line in windows)  # no group is one task's


@pytest.mark.parametrize("places", [1 << 16, 5])
def test_chromosome_kmers_by_stretches(spark, monkeypatch, places):
    monkeypatch.setattr(search, "PLACES", places)
    r = random.Random(6)
    seqs = {"a": [f"m{r.randrange(4)}" for _ in range(37)], "b": ["m1"] * 3, "c": [], "d": [f"m{r.randrange(2)}" for _ in range(10)]}
    occ = spark.createDataFrame([(c, i, m) for c, s in seqs.items() for i, m in enumerate(s)], "chrom string, idx int, motif string")
    for k in (1, 4, 5):
        got = sorted((x.chrom, x.idx, tuple(x.kmer)) for x in search.chromosome_kmers(occ, k).collect())
        assert got == sorted((c, i, tuple(s[i : i + k])) for c, s in seqs.items() for i in range(len(s) - k + 1))
    lacking = search.chromosome_kmers(occ.where("chrom <> 'd' or idx <> 4"), 4).where("chrom = 'd'").select("idx")
    assert sorted(x.idx for x in lacking.collect()) == [0, 5, 6]
    plan = search.chromosome_kmers(occ)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_scores_counted_where_blocks_meet(spark, monkeypatch):
    """reference_score_counts stands for the rows of reference_scores, and no pair is a row of its plan."""
    r = random.Random(5)
    monkeypatch.setattr(chains, "BLOCK", 4)
    monkeypatch.setattr(chains, "COUNTED", 16)
    names = [f"Chr1_{k * 100 + 1}to{k * 100 + 20 + k % 3}{'_rand' if k % 4 == 3 else ''}" for k in range(24)] + ["odd"]
    occ = spark.createDataFrame([(x, p, f"m{r.randrange(12)}") for x in names for p in range(r.randrange(1, 9))], "acr string, pos int, motif string")
    known = spark.createDataFrame([(x,) for x in names[::2] + ["absent"] if not x.endswith("_rand")], "region string")
    n = F.col("n_motifs")
    pairs = chains.motif_counts(occ).select(F.col("acr1").alias("r1"), F.col("acr2").alias("r2"), n.cast("double").alias("score"), n.alias("n_anchors"))
    rows = st.reference_scores(pairs, known).withColumn("ref_len", rg.length(*rg.endpoints(F.col("reference")))).cache()
    counts = st.reference_score_counts(occ, known).cache()
    listed = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert listed(counts) == listed(rows.groupBy("group", "region", "score", "n_anchors").agg(F.count("*").alias("n"), F.min("ref_len").alias("ref_len")))
    assert counts.agg(F.max("n")).first()[0] > 1
    value = F.col("score").alias("value")
    for a, b in (
        (st.nth_highest(counts, 3), st.nth_highest(rows, 3)),
        (st.highest(counts), st.highest(rows)),
        (st.top_mean(counts), st.top_mean(rows)),
        (st.padded_mean(counts, 50), st.padded_mean(rows, 50)),
        (st.nth_features(counts, 2), st.nth_features(rows, 2)),
        (st.with_padding(counts, 30, 30), st.with_padding(rows, 30, 30)),
        (st.density(counts, "score", 4, ["group"]), st.density(rows, "score", 4, ["group"])),
        (st.frequencies(counts.select("group", value, "n"), "value", ["group"]), st.frequencies(rows.select("group", value), "value", ["group"])),
        (st.frequencies(st.features_at(counts, 2.0, "n_anchors", 3), "value", ["group"]), st.frequencies(st.features_at(rows, 2.0, "n_anchors", 3), "value", ["group"])),
    ):
        assert listed(a) == listed(b) and listed(a)
    with pytest.raises(ValueError):
        st.reference_score_counts(occ, spark.createDataFrame([(names[3],)], "region string"))


def test_all_alignments_are_spread_and_batched(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    refs = [(k, text(r.randrange(30))) for k in range(40)] + [(90, ""), (91, None), (92, "ACéT")]
    asks = [(k, text(r.randrange(20))) for k in range(9)] + [(9, ""), (10, None)]
    got = search.align_all(spark.createDataFrame(refs, "id long, seq string").coalesce(1), spark.createDataFrame(asks, "id long, seq string").coalesce(1))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = got.collect()
    assert {(x.ref, x.query): x.align_score for x in rows} == {(i, j): None if a is None or b is None else kernels.affine_alignment(a, b) for i, a in refs for j, b in asks} and len(rows) == len(refs) * len(asks)
    both = spark.createDataFrame([(a, b) for _, a in refs for _, b in asks], "a_seq string, b_seq string")
    for x in search.aligned_pairs(both, free_ends=True).collect():
        assert x.align_score == (None if x.a_seq is None or x.b_seq is None else kernels.affine_alignment(x.a_seq, x.b_seq, True))


def test_direction_of_star_members_needs_no_anchors(monkeypatch):
    """Two sequences of one token have as many anchors as cells; their direction, and that of random ones, is the chains'."""
    import numpy as np

    from colinear.functions import batches

    rng, chained, cases = np.random.default_rng(1), batches.local_chains, []
    for trial in range(20):
        n, v = 30, 1 + trial % 5
        of1, of2 = (np.repeat(np.arange(n), rng.integers(0, 20, n)) for _ in range(2))
        t1, t2 = rng.integers(0, v, len(of1)), rng.integers(0, v, len(of2))
        cases.append((of1, t1, rng.integers(1, 7, v).astype(float)[t1], of2, t2, n, *[(-1.0, -1.0), (-2.0, -1.0), (-1.0, -3.0), (0.0, -1.0)][trial % 4]))
    uneven = [(*c[:2], c[2] + 0.0, *c[3:6], -0.5, -1.0) for c in cases]  # not whole: chained
    slow = [clustering._turned(*c) for c in uneven]
    for c in cases:
        of1, t1, w, of2, t2, n, mismatch, gap = c
        i, j = np.nonzero((of1[:, None] == of2) & (t1[:, None] == t2))
        place = lambda of: np.arange(len(of)) - np.searchsorted(of, of)
        slow.append(chained(batches.Pairs(np.bincount(of1[i], minlength=n), place(of1)[i], place(of2)[j], w[i]), w[i], mismatch, gap)[2])
    monkeypatch.setattr(batches, "local_chains", None)
    for c, want in zip(cases, slow[len(uneven) :]):
        assert (clustering._turned(*c) == want).all()
    assert any(x.any() for x in slow) and not all(x.all() for x in slow)
    same = np.zeros(2500, np.int64)
    assert not clustering._turned(same, same, np.full(2500, 5.0), same, same, 1, -1.0, -1.0).any()


def test_counts_of_some_pairs_only(spark, monkeypatch):
    """Listed pairs, and pairs within a cluster, are those of all pairs; no table of all pairs is made for them."""
    r = random.Random(8)
    monkeypatch.setattr(chains, "BLOCK", 3)
    monkeypatch.setattr(chains, "COUNTED", 8)
    names = [f"r{k:02}" for k in range(20)]
    occ = spark.createDataFrame([(x, p, f"m{r.randrange(9)}") for x in names for p in range(r.randrange(1, 5))], "acr string, pos int, motif string")
    every = {(x.acr1, x.acr2): x.n_motifs for x in chains.motif_counts(occ).collect()}
    pairs = [(r.choice(names), r.choice(names)) for _ in range(150)] + [("r01", "none"), ("none", "r01")]
    got = chains.listed_motif_counts(occ, spark.createDataFrame(pairs + pairs, "r1 string, r2 string")).collect()
    assert {(x.acr1, x.acr2): x.n_motifs for x in got} == {p: every[p] for p in pairs if p in every} and len(got) == len({p for p in pairs if p in every}) > 20
    cluster = {x: f"c{k % 3}" if k < 18 else None for k, x in enumerate(names)}
    got = chains.motif_counts(occ, within=spark.createDataFrame(list(cluster.items()), "acr string, cluster string")).collect()
    assert sorted((x.acr1, x.acr2, x.n_motifs) for x in got) == sorted((*p, n) for p, n in every.items() if cluster[p[0]] is not None and cluster[p[0]] == cluster[p[1]])
