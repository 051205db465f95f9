"""Centroid clustering of integer vectors: exact rounds of k-means under Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import forget, stored, table

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors with a scaled component of this size or above are left out: sums of squares over many of them don't fit a long.
LIMIT = 1 << 24
#: Relative room for rounding; bounds only get looser by it, so a bound that decides is right.
_EPS = 1e-12
_LONG = (1 << 63) - 1


def vectors(df: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, x array<int>): floor(scale * component) of vectors of exactly dim finite components."""
    fits = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LIMIT / scale))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def starts(vecs: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:vec_id`, in that order (a null vec_id counts as empty text; equal ones by components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vecs.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r.x for r in rows], np.int64)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centre, or to a centre each."""
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


def assigned(state: DataFrame, centres: np.ndarray, drift: np.ndarray) -> DataFrame:
    """One assignment of the state (vec_id, x, cluster, was, upper, lower, scans) to centres that moved by drift since the last one.

    upper is at least the distance to the vector's own centre, lower at most that to any other. Drift loosens both. Where upper is
    below lower, or below half the way from the own centre to the next one, the cluster stays; else upper is made exact; and
    where that doesn't decide either, all centres are scanned in integers (ties: the smaller number). scans counts those.
    """
    k = len(centres)
    far = np.array([np.sqrt(squared(centres, c).astype(float)) for c in centres])
    np.fill_diagonal(far, np.inf)
    half = far.min(1) / 2 * (1 - _EPS)
    others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(k)]) * (1 + _EPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            was, upper, lower, scans = (batch.column(i).to_numpy().copy() for i in (2, 4, 5, 6))
            cluster = np.maximum(was, 0)
            upper = (upper + drift[cluster]) * (1 + _EPS)
            lower = np.maximum(0.0, lower - others[cluster]) * (1 - _EPS)
            bound = np.maximum(lower, half[cluster])
            rows = np.flatnonzero(upper >= bound)
            upper[rows] = np.sqrt(squared(x[rows], centres[cluster[rows]]).astype(float)) * (1 + _EPS)
            rows = rows[upper[rows] >= bound[rows]]
            if len(rows):
                d = np.stack([squared(x[rows], c) for c in centres], 1)
                near = d.argmin(1)
                each = np.arange(len(rows))
                cluster[rows], upper[rows] = near, np.sqrt(d[each, near].astype(float)) * (1 + _EPS)
                d[each, near] = _LONG
                lower[rows] = np.sqrt(d.min(1).astype(float)) * (1 - _EPS)
                scans[rows] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], ["vec_id", "x", "cluster", "was", "upper", "lower", "scans"])

    return state.mapInArrow(run, "vec_id long, x array<int>, cluster int, was int, upper double, lower double, scans int")


def _moves(state: DataFrame, dim: int) -> list:
    """What changed clusters: a row for each pair of clusters at most, with exact sums."""
    return state.where("cluster <> was").groupBy("cluster", "was").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(dim)]).alias("total")).collect()


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding) -> ((vec_id, cluster, distance, scans), centres): a row for each vector kept.

    Each round is a table in the shared folder, with both bounds of every vector; the one before goes. Only what changed
    clusters is summed, by partial aggregates, so a cluster that holds most rows is no task's. Centres are k rows of dim
    integers. Without a change the rest of the rounds would repeat the last one, so they are left out.
    Null, short, long and non-finite vectors have no row. Repeated rows count each. Fewer vectors than k: as many centres;
    an empty table gives none.
    """
    vecs = vectors(df, dim, scale)
    centres = starts(vecs, k, seed)
    if not len(centres):
        none = vecs.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("scans")).where("false")
        return none, np.zeros((0, dim), np.int64)
    state = vecs.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"))
    drift = np.zeros(len(centres))
    sums, counts = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
    for turn in range(rounds + 1):
        last, state = state, stored(assigned(state, centres, drift))
        forget(last)
        if turn == rounds:
            break
        for row in _moves(state, dim):
            total = np.array(row.total, np.int64)
            sums[row.cluster] += total
            counts[row.cluster] += row.n
            if row.was >= 0:
                sums[row.was] -= total
                counts[row.was] -= row.n
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centres)
        drift = np.sqrt(squared(moved, centres).astype(float))
        centres = moved
        if not drift.any():
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            d = squared(x, centres[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d), batch.column(3)], ["vec_id", "cluster", "distance", "scans"])

    out = stored(state.select("vec_id", "x", "cluster", "scans").mapInArrow(run, "vec_id long, cluster int, distance long, scans int"))
    forget(state)
    return out, centres


def with_inertia(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (both at most the largest long) and centroid_sha256."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a cluster
    total = min(_LONG, sum(sums.values()))
    rows = [(c, min(_LONG, s), total, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    per = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings"))).drop("scans")


def _op11_sql() -> str:
    """The rounds one after another, each vector's components as rows."""
    text = f"""
WITH raw AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings),
cells AS (SELECT id, vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM raw),
kept AS (SELECT id FROM cells GROUP BY id HAVING max(n) = {DIM} AND count(v) = {DIM} AND bool_and(isfinite(v) AND abs(v) < {LIMIT / SCALE})),
e AS MATERIALIZED (SELECT c.id, c.vec_id, c.i, floor({SCALE} * c.v)::BIGINT AS x FROM cells c JOIN kept USING (id)),
start AS (SELECT id, row_number() OVER (ORDER BY h, xs) - 1 AS cluster FROM (SELECT id, sha256(concat('{SEED}:', any_value(vec_id))) AS h, list(x ORDER BY i) AS xs FROM e GROUP BY id) ORDER BY h, xs LIMIT {K}),
c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM start JOIN e USING (id))"""
    for r in range(ROUNDS + 1):
        text += f""",
d{r} AS (SELECT e.id, cluster, sum((x - c) * (x - c))::BIGINT AS d FROM e JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT id, min(struct_pack(d := d, cluster := cluster)) AS s FROM d{r} GROUP BY id)"""
        if r < ROUNDS:
            text += f""",
m{r} AS (SELECT a.s.cluster AS cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN e USING (id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, o.i, CASE WHEN m.n IS NULL THEN o.c ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS c FROM c{r} o LEFT JOIN m{r} m ON m.cluster = o.cluster AND m.i = o.i)"""
    return text + f""",
sha AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster),
f AS (SELECT id, (s.cluster)::INT AS cluster, s.d AS distance FROM a{ROUNDS})
SELECT raw.vec_id, f.cluster, f.distance, sum(f.distance) OVER (PARTITION BY f.cluster)::BIGINT AS cluster_inertia, sum(f.distance) OVER ()::BIGINT AS inertia, sha.centroid_sha256
FROM f JOIN raw USING (id) JOIN sha ON sha.cluster = f.cluster
"""


OP11_SQL = _op11_sql()
