import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from confab.llm import ann


def brute(rows, k=10):
    """Rows of one id count once, at the nearest of their vectors."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = min([best.get(i, 9e9), *(float(np.sqrt(((v - w) ** 2).sum())) for j, w in ok if j == q)])
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))


def rows():
    r = np.random.default_rng(2)
    own = [(i, r.normal(size=4).tolist()) for i in range(90, 330)]
    same = [0.5, 0.25, 0.125, 1.0]
    return own + [(1000 + i, same) for i in range(60)] + [(400, same), (400, same), (100, [9.0, 9.0, 9.0, 9.0]), (500, None), (600, []), (700, [0.0] * 4), (800, [1.0, None, 2.0, 3.0]), (900, [float("nan"), 1.0, 1.0, 1.0]), (1100, [float("inf"), 1.0, 1.0, 1.0]), (None, same), (1200, [1.0, 2.0])]


def run(spark, data, **kw):
    df = table(spark, data)
    return [tuple(x) for x in ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), **kw).orderBy("query_id", "rank").collect()]


def test_all_candidates_give_the_exact_answer(spark):
    got, want = run(spark, rows(), candidates=10**9), brute(rows())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-12)


def test_recall_of_prefixes(spark):
    r = np.random.default_rng(9)
    data = [(i, (c + 0.3 * r.normal(size=4)).tolist()) for i, c in enumerate(r.normal(size=(30, 4))[r.integers(0, 30, 6000)])]
    got, want = run(spark, data, candidates=3000, trees=8), brute(data)
    hit = {x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}
    assert len(got) == len(want) and len(hit) >= 0.9 * len(want)


def recall(spark, tmp_path, x, name, **kw):
    """Share of the 10 nearest of every hundredth row that are found; scores are those of the original vectors."""
    n = len(x)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), path := f"{tmp_path}/{name}.parquet")
    df = spark.read.parquet(path)
    asked = np.arange(0, n, 100)
    want = set()
    for q in asked.tolist():
        d = ((x[q].astype(float) - x.astype(float)) ** 2).sum(1)
        d[q] = np.inf
        want |= {(q, i) for i in np.argsort(d, kind="stable")[:10].tolist()}
    rows = ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), **kw).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(got) == len(want)
    exact = [float(np.sqrt(((x[r.query_id].astype(float) - x[r.vec_id].astype(float)) ** 2).sum())) for r in rows]
    assert [r.score for r in rows] == pytest.approx(exact, rel=1e-12)
    return len(got & want) / len(want)


def test_recall_holds_at_every_size_with_default_parameters(spark, tmp_path):
    """Isotropic noise of 64 dimensions, where prefixes help least."""
    for n in (600, 4000, 24_000):
        x = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
        assert recall(spark, tmp_path, x / np.linalg.norm(x, axis=1, keepdims=True), n) >= 0.9


def test_vectors_far_from_the_origin(spark, tmp_path):
    x = 1e6 + 0.01 * np.random.default_rng(6).normal(size=(600, 16))
    assert recall(spark, tmp_path, x, "far", candidates=10**9) == 1.0
    assert recall(spark, tmp_path, x, "far2") >= 0.9


def test_ascent_over_many_blocks(spark):
    """Counts under every prefix, and members of cells, whatever the blocks of the arrays are."""
    x = np.random.default_rng(8).integers(0, 1 << 12, (300, 3)) << 36
    x[:100, 0] = x[0, 0]
    index = spark.createDataFrame([(i, c) for i, c in enumerate(x.tolist())], "id long, codes array<long>")
    for block in (50, 10**6):
        arrays = ann.Arrays(index, 300, 3, 48, block)
        got = {r.q: r.counts for r in arrays.counts(index.filter("id % 7 = 0")).collect()}
        assert got == {q: [int(sum(((x[:, t] >> (48 - d)) == (x[q, t] >> (48 - d))).sum() for t in range(3))) for d in range(49)] for q in range(0, 300, 7)}
        cells = spark.createDataFrame([(1, 0, 0, (1 << 47) - 1), (2, 2, 1 << 46, (1 << 47) - 1), (3, 0, int(x[0, 0]), int(x[0, 0]))], "cell long, tree int, low long, high long")
        found = {(r.cell, r.id) for r in arrays.members(cells).collect()}
        assert found == {(c, i) for c, t, a, b in ((1, 0, 0, (1 << 47) - 1), (2, 2, 1 << 46, (1 << 47) - 1), (3, 0, x[0, 0], x[0, 0])) for i in range(300) if a <= x[i, t] <= b}


def test_distances_do_not_overflow():
    a, b = np.array([[1e200, 0.0], [1.0, 2.0], [1e-200, 0.0]]), np.array([[0.0, 1e200], [1.0, 0.0], [0.0, 0.0]])
    assert ann.distances(a, b) == pytest.approx([np.sqrt(2) * 1e200, 2.0, 1e-200])


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0, 0.0])]) == []
    assert run(spark, [(100, [1.0, 0.0]), (7, [1.0, 1.0])]) == [(100, 1, 7, 1.0)]
