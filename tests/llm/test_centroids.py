import hashlib
import math
import random

import numpy as np
import pytest

from confab.llm import centroids as c


def brute(vectors, k=40, rounds=5):
    """{position: (cluster, distance)} and the centroids, by measuring everything in whole numbers."""
    rows = [(i, v[0], [math.floor(256 * float(np.float32(x))) for x in v[1]]) for i, v in enumerate(vectors) if v[1] is not None and len(v[1]) == 64 and all(x is not None and math.isfinite(x) for x in v[1])]
    start = sorted(rows, key=lambda r: (r[1] is None, hashlib.sha256(f"2:{r[1]}".encode()).hexdigest(), r[2]))
    centres = [list(r[2]) for r in start[:k]]
    for nth in range(rounds + 1):
        got = {}
        for i, _, x in rows:
            d = [sum((a - b) ** 2 for a, b in zip(x, m, strict=True)) for m in centres]
            got[i] = (d.index(min(d)), min(d))
        if nth < rounds:
            for j in range(len(centres)):
                own = [x for i, _, x in rows if got[i][0] == j]
                if own:
                    centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(vid, x, *got[i]) for i, vid, x in rows], centres


def awkward_vectors():
    r = random.Random(5)
    place = [[r.gauss(0, 0.3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [p + r.gauss(0, 0.05) for p in place[i % 9]]) for i in range(260)]
    rows += [(1000 + i, place[0]) for i in range(70)]  # one vector very often
    rows += [(5, [0.25] * 64), (5, [0.25] * 64), (5, [-0.5] * 64), (None, [0.1] * 64), (None, place[3]), (7, None), (8, []), (9, [1.0] * 63), (10, [1.0] * 65)]
    return rows + [(11, [math.nan] + [0.0] * 63), (12, [None] + [0.0] * 63), (13, [math.inf] + [0.0] * 63), (14, [0.0] * 64), (15, [300.0] * 64)]


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(n) for n in ("x", "cluster", "distance", "next", "low", "rest", "measured")})


def test_equals_measuring_everything(spark):
    rows = awkward_vectors()
    want, centres = brute(rows)
    found = c.clustered(c.quantised(frame(spark, rows).repartition(5)))
    got = [(r.vec_id, list(r.x), r.cluster, r.distance) for r in found.rows.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert found.centres.tolist() == centres
    assert found.inertia == {j: sum(w[3] for w in want if w[2] == j) for j in {w[2] for w in want}}
    assert sum(found.measured[1:]) < 5 * len(want) * len(centres)  # bounds spare distances


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [2.0] * 64), (3, [2.0] * 64)]
    found = c.clustered(c.quantised(frame(spark, rows)))
    assert len(found.centres) == 3 and {r.distance for r in found.rows.collect()} == {0}
    assert c.clustered(c.quantised(frame(spark, []))).rows.collect() == []
    assert len(c.clustered(c.quantised(frame(spark, rows)), k=1).centres) == 1
    with pytest.raises(Exception, match="component beyond"):
        c.quantised(frame(spark, [(1, [1e9] * 64)])).collect()


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_while_centroids_move(seed):
    """Random moves, large ones too: the own centroid is the nearest and each bound holds for all beyond its place."""
    rng = np.random.default_rng(seed)
    x, centres = rng.integers(-200, 200, (300, 6)), rng.integers(-200, 200, (12, 6))
    centres[5] = centres[2]
    now = c.scan(x, centres, 4)
    for step in range(12):
        new = centres + rng.integers(-9, 10, centres.shape) * (rng.random((12, 1)) < 0.5) * (step % 4)
        now = c.moved(x, now, new, np.sqrt(((new - centres) ** 2).sum(1)), 4 if step < 8 else 2)
        centres, square = new, c.squares(x, new)
        assert (now.own == square.argmin(axis=1)).all() and (now.square == square.min(axis=1)).all()
        bound = c._falling(now.low, now.rest)
        for i in range(len(x)):
            seen = {int(now.own[i])}
            for j in range(bound.shape[1]):
                beyond = [square[i, z] for z in range(12) if z not in seen]
                assert not beyond or bound[i, j] <= math.sqrt(min(beyond))
                if j < now.next.shape[1]:
                    seen.add(int(now.next[i, j]))


def test_squares_are_exact_when_large():
    x, m = np.array([[1 << 27] * 64]), np.array([[-(1 << 27)] * 64, [(1 << 27) - 1] * 64])
    assert c.squares(x, m).tolist() == [[64 << 56, 64]]


def test_query_columns(spark):
    got = c.op11_centroids(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = got.collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, centres = brute(vectors)
    by = {j: sum(w[3] for w in want if w[2] == j) for j in {w[2] for w in want}}
    text = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    assert sorted(map(tuple, rows)) == sorted((v, j, d, by[j], sum(by.values()), text(j)) for v, _, j, d in want)
