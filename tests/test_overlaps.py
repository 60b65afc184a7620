"""Speakers' overlaps by a sweep against all pairs."""

import random
from collections import defaultdict

from confab.operators import segments as s

KIND = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long"


def brute(rows, least=200):
    by = defaultdict(lambda: defaultdict(list))
    for rec, _, who, a, b in rows:
        if who is not None and a is not None and b is not None:
            by[rec][who].append((a, b))
    return {(rec, x, y) for rec, own in by.items() for x in own for y in own if x < y and any(min(b, d) - max(a, c) > least for a, b in own[x] for c, d in own[y])}


def test_equals_all_pairs(spark):
    r, rows = random.Random(2), []
    for rec in range(60):
        for i in range(r.randrange(1, 30)):
            a = r.randrange(0, 4000 if rec % 2 else 60_000)
            rows.append((rec, i, r.choice(["A", "B", "C", "D", None] if rec % 7 == 0 else ["A", "B", "C"]), a if i % 13 else None, a + r.choice([0, 150, 201, 900, -50, 30_000 if rec % 3 == 0 else 300])))
    got = {tuple(x) for x in s.speakers_overlap(spark.createDataFrame(rows, KIND)).collect()}
    assert got == brute(rows) and got


def test_a_crowded_minute(spark):
    """10,000 intervals of four speakers in one minute; only two of the pairs overlap."""
    r = random.Random(4)
    rows = [(1, i, "AB"[i % 2] if i % 4 < 2 else "CD"[i % 2], a := r.randrange(0, 29_000) + (30_000 if i % 4 > 1 else 0), a + r.randrange(205, 900)) for i in range(10_000)]
    got = sorted(tuple(x) for x in s.speakers_overlap(spark.createDataFrame(rows, KIND)).collect())
    assert got == sorted(brute(rows)) == [(1, "A", "B"), (1, "C", "D")]
