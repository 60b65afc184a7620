"""Greedy runs by doubling against plain loops, over awkward and one very long recording."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import jumps as j
from confab.operators import text as x


def batches(lens, max_chars, max_rows):
    out, batch, n, chars = [], 0, 0, 0
    for k in lens:
        n, chars = n + 1, chars + k
        out.append(batch)
        if chars >= max_chars or n >= max_rows:
            batch, n, chars = batch + 1, 0, 0
    return out


def windows(starts, width):
    out, at, win, n = [], 0, 0, 0
    for s in starts:
        if s - at >= width and n:
            at, win, n = s, win + 1, 0
        n += 1
        out.append(win)
    return out


def chunks(lens, back, least_rows, least_chars):
    out, first = [], 0
    while True:
        own = list(range(first, min(len(lens), first + (back if first else 0))))
        fresh = own[-1] + 1 if own else first
        for i in range(fresh, len(lens)):
            own.append(i)
            if len(own) >= least_rows and sum(lens[k] for k in own) >= least_chars:
                break
        out.append((own[0], own[-1]))
        done = len(own) >= least_rows and sum(lens[k] for k in own) >= least_chars
        if not done or own[-1] + 1 >= len(lens):
            return out
        first = own[-1] + 1 - back


def recordings():
    r, out = random.Random(3), {}
    for rec in range(40):
        n = r.choice([1, 2, 3, 5, 16, 90])
        at, rows = r.choice([0, 0, 400_000]), []
        for i in range(n):
            at += r.choice([0, 10, 20_000, 350_000, -15_000, -400_000 if rec % 5 == 0 else 5])
            rows.append((rec, i * 2 + 3, "x" * r.choice([0, 1, 40, 200, 601, 3100]), max(0, at), max(0, at) + 50))
        out[rec] = rows
    return out


@pytest.fixture(scope="module")
def segs(spark):
    return recordings(), spark.createDataFrame([row for rows in recordings().values() for row in rows], "recording_id long, seg_id int, text string, start_ms long, end_ms long")


@pytest.mark.parametrize("limits", [(3000, 15), (100, 4), (1, 1)])
def test_batches(segs, limits):
    rows, df = segs
    want = {(rec, row[1]): b for rec, own in rows.items() for row, b in zip(own, batches([len(row[2]) for row in own], *limits), strict=True)}
    assert {(r.recording_id, r.seg_id): r.batch_id for r in x.translation_batches(df, *limits).collect()} == want


@pytest.mark.parametrize("width", [300_000, 15_000, 1])
def test_windows(segs, width):
    rows, df = segs
    want = {}
    for rec, own in rows.items():
        for row, w in zip(own, windows([row[3] for row in own], width), strict=True):
            want.setdefault((rec, w), []).append(row)
    got = x.topic_windows(df, width, most=1000).collect()
    assert {(r.recording_id, r.win_id): (r.start_ms, r.end_ms, r.n) for r in got} == {k: (min(v[3] for v in own), max(v[4] for v in own), len(own)) for k, own in want.items()}


@pytest.mark.parametrize("limits", [(2, 3, 600), (0, 1, 50), (1, 4, 1), (2, 3, 0)])
def test_chunks(segs, limits):
    rows, df = segs
    want = {(rec, c): (own[a][1], own[b][1]) for rec, own in rows.items() for c, (a, b) in enumerate(chunks([len(row[2]) for row in own], *limits))}
    assert {(r.recording_id, r.chunk_id): (r.first_idx, r.last_idx) for r in x.sliding_chunks(df, *limits).collect()} == want


def test_one_recording_of_many_rows(spark):
    """One recording of 300,000 rows: no Python worker, and the loop's result."""
    n = 300_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").cast("int").alias("seg_id"), F.repeat(F.lit("y"), (F.col("id") * 7919 % 601).cast("int")).alias("text"))
    got = x.translation_batches(df)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("seg_id").toPandas()
    assert rows.seg_id.tolist() == list(range(n)) and rows.batch_id.tolist() == batches([i * 7919 % 601 for i in range(n)], 3000, 15)


def test_reached_follows_pointers(spark):
    assert [r.i for r in j.reached(spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 3), (1, 3, 7), (1, 7, None)], "recording_id long, i long, to long")).orderBy("i").collect()] == [0, 3, 7]
    assert j.reached(spark.createDataFrame([], "recording_id long, i long, to long")).collect() == []
