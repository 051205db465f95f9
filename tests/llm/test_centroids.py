"""Centroid clustering against a plain Python version of its rules."""

import hashlib
import random

import pytest

from colinear.llm import centroids

VECS = "vec_id long, embedding array<double>, cluster string, x string, was string"


def brute(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int((scale * v) // 1) for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and abs(v) < centroids.LIMIT / scale for v in e)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((d2(x, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            members = [x for (_, x), c in zip(kept, own) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), centres


def table(rows):
    return [(i, e, "c", "x", "w") for i, e in rows]


@pytest.mark.parametrize("case", range(4))
def test_equals_brute_force(spark, case):
    r = random.Random(case)
    dim, k, scale = 3, (1, 4, 8, 12)[case], (8, 3, 1024, 2)[case]
    middles = [[r.uniform(-2, 2) for _ in range(dim)] for _ in range(5)]
    # coarse scales give many ties; a third of the rows are one vector
    rows = [(i, [m + r.gauss(0, 0.4) for m in r.choice(middles)]) for i in range(200)] + [(200 + i, [0.5, -0.5, 0.25]) for i in range(100)]
    rows += [(7, None), (8, [1.0]), (9, [1.0, None, 2.0]), (10, [float("nan"), 0.0, 0.0]), (11, [float("inf"), 0.0, 0.0]), (12, [1e30, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (3, [0.0, 0.0, -0.0]), (3, [0.0, 0.0, 0.0])]
    want, centres = brute(rows, k, 10, dim, scale, 3)
    df = spark.createDataFrame(table(rows), VECS)
    for parts in (1, 5):
        found, got = centroids.clustered(df.repartition(parts), k, 10, dim, scale)
        assert got.tolist() == centres
        found = centroids.with_inertia(found, got).collect()
        assert sorted(((x.vec_id, x.cluster, x.distance) for x in found), key=str) == want
        assert {x.inertia for x in found} == {sum(d for *_, d in want)}
        assert all(x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster) for x in found)
        assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[x.cluster])).encode()).hexdigest() for x in found)


def test_bounds_spare_scans(spark):
    r = random.Random(9)
    rows = [(i, [100.0 * (i % 8) + r.gauss(0, 1), r.gauss(0, 1)]) for i in range(400)]
    found, _ = centroids.clustered(spark.createDataFrame(table(rows), VECS), 8, 10, 2, 16)
    assert sum(x.scans for x in found.collect()) < 400 * 4


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(table([(1, [1.0, 2.0]), (2, [3.0, 4.0])]), VECS)
    found, got = centroids.clustered(df, 8, 10, 2, 1)
    assert len(got) == 2 and sorted((x.vec_id, x.distance) for x in found.collect()) == [(1, 0), (2, 0)]
    none = centroids.with_inertia(*centroids.clustered(df.where("false"), 8, 10, 2, 1))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"]
