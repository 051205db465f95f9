"""Distance clustering, medoids and consensus sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions import batches, kernels
from colinear.functions.scores import global_distance, local_distance
from colinear.session import forget, stored


#: Rows of regions that are sent to every task, so that pairs stay where they are; more are joined.
SENT = 500_000


def _sent(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if known.count() <= SENT else lambda df: df


def chain_distances(chains: DataFrame, lengths: DataFrame, alpha: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(id1, id2, distance) of global chains (acr1, acr2, chain) and sequence lengths (acr, n_motifs)."""
    lengths = stored(lengths.select("acr", "n_motifs"))
    sent = _sent(lengths)
    side = lambda k: sent(lengths.select(F.col("acr").alias(f"acr{k}"), F.col("n_motifs").alias(f"n{k}")))
    both = chains.join(side(1), "acr1").join(side(2), "acr2")
    d = global_distance(F.greatest("n1", "n2"), F.least("n1", "n2"), F.col("chain"), alpha, scale)
    return both.select(F.col("acr1").alias("id1"), F.col("acr2").alias("id2"), d.alias("distance"))


def local_distances(chains: DataFrame, beta: float = 1.0) -> DataFrame:
    """(id1, id2, distance) of local chains (acr1, acr2, score); pairs of score 0 have none."""
    return chains.select(F.col("acr1").alias("id1"), F.col("acr2").alias("id2"), local_distance(F.col("score"), beta).alias("distance")).where("distance is not null")


#: Edges between clusters that one task finishes; more are merged in rounds.
FINISH = 50_000
#: Distances are compared to so many digits; sums are exact decimals, so the order of rows never decides.
DIGITS = 9


def _linked(edges: DataFrame, average: bool, missing: float) -> DataFrame:
    """Adds d, the distance of two clusters: from s, the sum, n, the number, and m, the largest, of the distances between their members."""
    pairs = F.col("na") * F.col("nb")
    d = (F.col("s").cast("double") + missing * (pairs - F.col("n"))) / pairs if average else F.greatest("m", F.when(F.col("n") < pairs, F.lit(float(missing))))
    return edges.withColumn("d", F.round(d, DIGITS))


def _reciprocal(near: DataFrame) -> DataFrame:
    """(c, into, size) of the pairs of clusters (a, b, na, nb, d) that are each other's nearest one: the smaller label takes both."""
    edge = F.struct("d", "a", "b", (F.col("na") + F.col("nb")).alias("size")).alias("e")
    best = near.select(F.explode(F.array("a", "b")).alias("x"), edge).groupBy("x").agg(F.min("e").alias("e"))
    mutual = best.groupBy("e").agg(F.count("*").alias("k")).where("k = 2")
    return mutual.select(F.explode(F.array("e.a", "e.b")).alias("c"), F.col("e.a").alias("into"), F.col("e.size").alias("size"))


def _merged(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges after the moves: sums and numbers add up, so nothing but edges is looked at."""
    side = lambda k: moves.select(F.col("c").alias(k), F.col("into").alias(f"{k}_into"), F.col("size").alias(f"{k}_size"))
    moved = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    a, b = F.coalesce("a_into", "a"), F.coalesce("b_into", "b")
    na, nb = F.coalesce("a_size", "na"), F.coalesce("b_size", "nb")
    moved = moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a <= b, na).otherwise(nb).alias("na"), F.when(a <= b, nb).otherwise(na).alias("nb"), "s", "n", "m").where("a <> b")
    return moved.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("s").cast(dict(edges.dtypes)["s"]).alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"))


def clusters(distances: DataFrame, threshold: float, ids: DataFrame | None = None, average: bool = True, missing: float = 1.0, finish: int = FINISH) -> DataFrame:
    """(id, cluster): agglomerative clusters; cluster is the smallest id of its members.

    The nearest two clusters merge while their distance (average: the mean over members, else the largest) is below threshold
    (complete linkage: not above); ties by the labels. Pairs without a distance have `missing`, negative distances count 0, of several
    for a pair the smallest. ids: all ids, also those without a pair. Both linkages are reducible: a merge brings no other
    cluster nearer, so all pairs that are each other's nearest merge in one round, with the result of one merge after another.
    A round is joins and sums over the edges; no component or cluster is gathered. Up to `finish` edges, counted first, go to
    one task for the rest.
    """
    if threshold > missing:
        raise ValueError("clusters: threshold must not be above the distance of missing pairs")
    kind = dict(distances.dtypes)["id1"]
    listed = distances.where("id1 <> id2").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), F.greatest(F.col("distance"), F.lit(0.0)).alias("m"))
    edges = listed.groupBy("a", "b").agg(F.min("m").alias("m"))
    one = F.lit(1).cast("long")
    total = F.col("m").cast("decimal(28,12)").cast("decimal(38,12)") if average else F.lit(0).cast("long")  # complete linkage needs no sums
    edges = stored(edges.select("a", "b", one.alias("na"), one.alias("nb"), total.alias("s"), one.alias("n"), "m"))
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("cluster", F.col("id")))
    near = (F.col("d") < threshold) if average else (F.col("d") <= threshold)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        into = kernels.linkage_edges(rows, threshold, average, missing, DIGITS)
        if into:
            yield pa.RecordBatch.from_arrays([pa.array(list(into)), pa.array(list(into.values()))], ["c", "into"])

    while True:
        last = edges.count() <= finish
        moves = stored(edges.select("a", "b", "na", "nb", "s", "n", "m").coalesce(1).mapInArrow(finished, f"c {kind}, into {kind}") if last else _reciprocal(_linked(edges, average, missing).where(near)))
        moved = stored(labels.join(moves, labels["cluster"] == moves["c"], "left").select("id", F.coalesce("into", "cluster").alias("cluster")))
        forget(labels)
        labels = moved
        if last or moves.isEmpty():
            break
        after = _merged(edges, moves)
        if not average:
            after = _linked(after, average, missing).where(near).drop("d")  # a largest distance only grows
        after = stored(after)
        forget(edges)
        forget(moves)
        edges = after
    everyone = ids.select("id") if ids is not None else distances.select(F.col("id1").alias("id")).union(distances.select("id2")).distinct()
    found = labels.select(F.col("id").alias("_id"), "cluster")
    return everyone.join(found, everyone["id"] == found["_id"], "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def medoids(clustered: DataFrame, distances: DataFrame, missing: float = 1.0, more_than: int = 0) -> DataFrame:
    """(cluster, representative, n): the member of the least sum of distances to the others, of equals the first by id;
    of clusters of over `more_than` members.

    Missing pairs are counted, not made: a member's sum is that of its pairs plus `missing` for each other one.
    """
    clustered = stored(clustered.select("id", "cluster"))
    sent = _sent(clustered)
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    c = lambda k: sent(clustered.select(F.col("id").alias(f"id{k}"), F.col("cluster").alias(f"c{k}")))
    near = distances.select("id1", "id2", F.greatest(F.col("distance"), F.lit(0.0)).alias("d")).join(c(1), "id1").join(c(2), "id2").where("c1 = c2")
    own = near.select(F.explode(F.array("id1", "id2")).alias("id1"), "d").groupBy("id1").agg(F.sum("d").alias("total"), F.count("*").alias("pairs"))
    each = clustered.join(sizes, "cluster").join(own.withColumnRenamed("id1", "id"), "id", "left")
    total = F.coalesce("total", F.lit(0.0)) + missing * (F.col("n") - 1 - F.coalesce("pairs", F.lit(0)))
    return each.groupBy("cluster").agg(F.min_by("id", F.struct(F.round(total, 9), "id")).alias("representative"), F.first("n").alias("n"))


#: Vectors of a block at most, and about as many numbers; blocks of a task's side, so that what it holds is bounded.
VECTORS, NUMBERS, HELD = 1024, 1 << 18, 64


def _near(u: np.ndarray, v: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows of unit vectors whose distance is below a bound: single precision rules pairs out by more than its error, double decides."""
    n, width = u.shape[0], u.shape[1]
    likely = np.flatnonzero(u.astype(np.float32) @ v.astype(np.float32).T > np.float32(1 - below - (width + 8) * 2.0**-22))
    i, j = np.divmod(likely, max(1, len(v)))
    if 8 * len(i) > n * len(v):
        d = 1 - (u @ v.T)[i, j]
    else:
        step = max(1, NUMBERS // max(1, width))
        d = np.concatenate([1 - np.einsum("ij,ij->i", u[i[a : a + step]], v[j[a : a + step]]) for a in range(0, len(i), step)] or [np.zeros(0)])
    keep = d < below
    return i[keep], j[keep], np.maximum(d[keep], 0.0)


def vector_distances(vectors: DataFrame, below: float, block: int = VECTORS) -> DataFrame:
    """(id1, id2, distance), id1 < id2, of vectors (id, x) whose correlation distance is below a bound.

    Vectors are made unit vectors once and packed in blocks of up to `block`; blocks meet blocks, each pair of them in one
    matrix product; only near pairs leave it. A vector without spread has distance 1 to all.
    """
    count, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    n = max(1, -(-count // max(1, min(block, NUMBERS // max(1, width)))))
    kind = dict(vectors.dtypes)["id"]

    def units(group: pa.Table) -> pa.Table:
        x = group.column("x").combine_chunks()
        if pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(x), -1), width)).as_py():
            raise ValueError("vector_distances: vectors of different lengths")
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), width)
        x = x - x.mean(1, keepdims=True)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids = group.column("id").combine_chunks()
        return pa.table({"b": group.column("b").slice(0, 1), "ids": pa.ListArray.from_arrays([0, len(ids)], ids), "units": pa.array([x.tobytes()], pa.binary())})

    dealt = vectors.select("id", F.col("x").cast("array<double>").alias("x"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"))
    packed = stored(dealt.groupBy("b").applyInArrow(units, f"b long, ids array<{kind}>, units binary"))
    side = lambda k: packed.repartition(max(8, -(-n // HELD)), "b").select(*(F.col(c).alias(f"{c}{k}") for c in ("b", "ids", "units")))
    pairs = side(1).join(side(2), F.expr("b1 <= b2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("b1", "ids1", "units1", "b2", "ids2", "units2")}
            for k in range(batch.num_rows):
                ids1, ids2 = columns["ids1"][k].values, columns["ids2"][k].values
                u, v = (np.frombuffer(columns[c][k].as_buffer(), float).reshape(len(ids), width) for c, ids in (("units1", ids1), ("units2", ids2)))
                i, j, d = _near(u, v, below)
                a, b = ids1.take(pa.array(i)), ids2.take(pa.array(j))
                less = pc.less(a, b)
                keep = less if columns["b1"][k].as_py() == columns["b2"][k].as_py() else pc.not_equal(a, b)
                one = pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(d)], ["id1", "id2", "distance"])
                yield one.filter(keep)

    return pairs.mapInArrow(run, f"id1 {kind}, id2 {kind}, distance double")


def evalue_table(hits: DataFrame) -> DataFrame:
    """(query, target, evalue) -> symmetric (motif1, motif2, similarity): the smaller E-value of both directions."""
    from colinear.functions.scores import evalue_similarity

    both = hits.select(F.col("query").alias("motif1"), F.col("target").alias("motif2"), "evalue").union(hits.select("target", "query", "evalue"))
    least = both.groupBy("motif1", "motif2").agg(F.min(F.when(~F.isnan("evalue"), F.col("evalue"))).alias("e"))
    return least.select("motif1", "motif2", evalue_similarity(F.col("e")).alias("similarity"))


def column_majority(aligned: DataFrame, blank: str = "-") -> DataFrame:
    """(cluster, row, tokens) -> (cluster, pos, token): tokens that more than half of a column's rows have, blanks left out."""
    cells = aligned.select("cluster", F.posexplode("tokens").alias("pos", "token"))
    counts = cells.groupBy("cluster", "pos", "token").agg(F.count("*").alias("k"))
    rows = aligned.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.join(rows, "cluster").where((2 * F.col("k") > F.col("n")) & (F.col("token") != blank)).select("cluster", "pos", "token")


def _turned(of1: np.ndarray, tokens1: np.ndarray, weights: np.ndarray, of2: np.ndarray, tokens2: np.ndarray, n: int, mismatch: float, gap: float) -> np.ndarray:
    """Whether the second side's best local chain with the first one runs backwards, of n cases; positions are places in the sequences.

    Between two anchors a chain pays for the diagonal steps and gaps of a local alignment, so where a match is worth more than a mismatch or gaps
    the best chain's score is that of the best alignment: its cells are the product of the lengths, chains take the square of the anchors. Whole
    numbers add up to the same either way; others are chained, as sums in another order may break a tie.
    """
    sizes1, sizes2 = np.bincount(of1, minlength=n), np.bincount(of2, minlength=n)
    starts1, starts2 = np.cumsum(sizes1) - sizes1, np.cumsum(sizes2) - sizes2
    if (weights > 0).all() and 2 * gap <= mismatch <= 0 and gap <= 0 and all((np.asarray(x) == np.round(x)).all() for x in (weights, mismatch, gap)):
        back = starts2[of2] + sizes2[of2] - 1 - (np.arange(len(of2)) - starts2[of2])
        ahead, behind = (batches.local_alignments(of1, tokens1, weights, of2, tokens2[at], n, mismatch, gap)[0] for at in (np.arange(len(of2)), back))
        return behind > ahead
    width = int(max(tokens1.max(initial=0), tokens2.max(initial=0))) + 1
    key1, key2 = of1 * width + tokens1, of2 * width + tokens2  # anchors are equal tokens of one case
    order = np.argsort(key2, kind="stable")
    lo, hi = np.searchsorted(key2[order], key1, "left"), np.searchsorted(key2[order], key1, "right")
    i = np.repeat(np.arange(len(key1)), hi - lo)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    case = of1[i]
    pairs = batches.Pairs(np.bincount(case, minlength=n), i - starts1[case], j - starts2[case], weights[i])
    return batches.local_chains(pairs, weights[i], mismatch, gap)[2]


def star_columns(members: DataFrame, weights: dict[str, float] | None = None, match: float = 5.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """(cluster, id, motifs, is_center) -> (cluster, id, place, offset, token): the star alignment to each cluster's centre, a row a token.

    The centre is the first member by (flagged, id). Each member is turned if its best local chain with the centre runs backwards, and
    aligned to the centre; offset -1 stands on the centre's token at place, from 0 on are tokens put in before it. Columns of a
    cluster are its (place, offset), so members meet in sums only and no cluster is one task's.
    """
    center = members.groupBy("cluster").agg(F.min_by("motifs", F.struct(~F.col("is_center"), F.col("id"))).alias("center"))
    tasks = 4 * members.sparkSession.sparkContext.defaultParallelism
    cases = members.select("cluster", "id", "motifs").join(center, "cluster").repartition(tasks, "cluster", "id")  # a join by cluster leaves few tasks
    known = weights or {}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            cluster, name, own, middle = (batch.column(batch.schema.get_field_index(c)) for c in ("cluster", "id", "motifs", "center"))
            sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (middle, own)]
            of1, of2 = (np.repeat(np.arange(n), x) for x in sizes)
            both = pa.concat_arrays([middle.flatten(), own.flatten()]).dictionary_encode()
            tokens = both.dictionary.to_pylist()
            codes = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first, second = codes[: len(of1)], codes[len(of1) :].copy()
            worth = np.array([known.get(t, match) for t in tokens] or [match], float)
            starts2 = np.cumsum(sizes[1]) - sizes[1]
            turned = _turned(of1, first, worth[first], of2, second, n, mismatch, gap)
            at = np.arange(len(second))
            at = np.where(turned[of2], starts2[of2] + sizes[1][of2] - 1 - (at - starts2[of2]), at)
            second = second[at]
            place, offset = batches.global_alignments(of1, first, worth[first], of2, second, n, mismatch, gap)
            take = pa.array(of2)
            yield pa.RecordBatch.from_arrays([cluster.take(take), name.take(take), pa.array(place, pa.int32()), pa.array(offset, pa.int32()), both.dictionary.take(pa.array(second))], ["cluster", "id", "place", "offset", "token"])

    kinds = dict(members.dtypes)
    return cases.mapInArrow(run, f"cluster {kinds['cluster']}, id {kinds['id']}, place int, offset int, token string")


def star_consensus(members: DataFrame, least: int = 5, weights: dict[str, float] | None = None, match: float = 5.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """(cluster, id, motifs, is_center) -> (cluster, tokens): consensus of at least `least` motifs: tokens of star_columns that more
    than half of the members have, in order of the columns; what is put in before a centre's token comes before it."""
    cells = star_columns(members, weights, match, mismatch, gap)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = cells.groupBy("cluster", "place", "offset", "token").agg(F.count("*").alias("k")).join(sizes, "cluster").where(2 * F.col("k") > F.col("n"))
    column = F.struct("place", F.when(F.col("offset") < 0, F.lit(2**31 - 1)).otherwise(F.col("offset")).alias("offset"), "token")
    ordered = counts.groupBy("cluster").agg(F.array_sort(F.collect_list(column)).alias("c"))  # a row a consensus token
    found = members.select("cluster").distinct().join(ordered, "cluster", "left").select("cluster", F.coalesce(F.transform("c", lambda x: x["token"]), F.array().cast("array<string>")).alias("tokens"))
    return found.where(F.size("tokens") >= least)


def consensus_matrices(members: DataFrame) -> DataFrame:
    """(cluster, motif, pssm) -> (cluster, pssm): mean matrix over the progressive profile alignment of the members, the longest first.

    A task takes a cluster: motifs that are one cluster are few and short.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted((r for r in group.to_pylist() if r["pssm"]), key=lambda r: (-len(r["pssm"]), r["motif"]))
        mean = kernels.progressive_profile([r["pssm"] for r in rows]) if rows else []
        return pa.table({"cluster": group.column("cluster").slice(0, 1), "pssm": pa.array([mean], pa.list_(pa.list_(pa.float64())))})

    kind = dict(members.dtypes)["cluster"]
    return members.groupBy("cluster").applyInArrow(run, f"cluster {kind}, pssm array<array<double>>")
