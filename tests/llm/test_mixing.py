from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from confab.llm import mixing
from tests.llm.support import awkward, table, words


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        rate = sum(weights[s] for s in sizes if s not in full)
        goal = {s: cap * sizes[s] if s in full else left * weights[s] / rate for s in sizes}
        over = {s for s in sizes if s not in full and goal[s] > cap * sizes[s] + 1e-9}
        if not over:
            return goal
        full |= over


def test_targets_and_taken_words(spark):
    docs = table(spark, awkward())
    placed = mixing.curriculum(docs, carry=["doc_id", "source", "text"], buckets=4).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in placed:
        assert r["size"] == len(words(r.doc.text))
        sizes[r.doc.source] += r["size"]
        own = sum(c.words for c in r.copies)
        assert own <= 2 * r["size"]
        taken[r.doc.source] += own
    order = sorted(sizes, key=lambda s: (s is None, s))
    goal = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    assert len(placed) == len(awkward())
    for r in placed:
        assert r.source_size == sizes[r.doc.source]
        assert abs(r.target - goal[r.doc.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1


def test_positions_invert_the_demand(spark):
    """At any time the words placed before it are the integral of the source's schedule."""
    rows = [(i, "w " * 10, s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 200)]
    placed = mixing.curriculum(table(spark, rows), carry=["source"], buckets=8)
    copies = placed.select("doc.source", "target", F.explode("copies").alias("c")).select("source", "target", "c.*").collect()
    shapes = dict(zip("abc", mixing.SHAPES, strict=True))
    for s in "abc":
        own = sorted((c.position, c.words) for c in copies if c.source == s)
        target = next(c.target for c in copies if c.source == s)
        assert 0 <= own[0][0] and own[-1][0] <= 1
        a, m, b = shapes[s]
        for t in (0.25, 0.5, 0.8):
            area = (a + (m - a) * t) * t if t <= 0.5 else (a + m) / 4 + (m + (b - m) * (t - 0.5)) * (t - 0.5)
            before = sum(w for p, w in own if p < t)
            assert abs(before - area * target) <= 0.02 * target + 20


def test_mixed_rows(spark):
    docs = table(spark, awkward()).withColumn("n_chars", F.length("text").cast("long"))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    total = sum(len(words(r[1])) for r in awkward())
    assert abs(sum(len(words(r.text)) for r in got.collect()) - 1.5 * total) <= 5
    once = table(spark, [r for r in awkward() if r[0] not in (16, 17)])
    rows = mixing.mixed(once).collect()
    assert abs(sum(len(words(r.text)) for r in rows) - 1.5 * sum(len(words(r[1])) for r in awkward() if r[0] not in (16, 17))) <= 5
    assert rows == mixing.mixed(once).collect()


def test_empty_table(spark):
    assert mixing.curriculum(table(spark, [])).collect() == []
    assert mixing.mixed(table(spark, [])).collect() == []


def test_pipeline_mixes_whole_texts(spark):
    rows = [(i, f"{i} " * (7 + i % 5 * 20) + "\n\tend", "abc"[i % 3]) for i in range(60)]
    docs = table(spark, rows)
    got, sizes = [(r.doc_id, r.text) for r in cp.mixing_stage(spark, docs, "").collect()], {i: len(words(t)) for i, t, _ in rows}
    assert set(got) <= {(i, t) for i, t, _ in rows} and max(got.count(g) for g in set(got)) <= 2
    for s in "abc":
        target = next(r.target for r in mixing.curriculum(docs, carry=["source"]).collect() if r.doc.source == s)
        assert abs(sum(sizes[i] for i, _ in got if "abc"[i % 3] == s) - target) <= max(sizes.values()) / 2 + 1
