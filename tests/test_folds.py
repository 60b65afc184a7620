"""Folds against loops written from their description."""

import random
from collections import OrderedDict

import pytest

from confab.operators import folds, votes
from confab.operators import text as x

SCHEMA = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long, text string"


def lists(seed, n=30):
    r = random.Random(seed)
    rows = []
    for rec in range(n):
        at = 0
        for i in range(r.randrange(1, 25)):
            at += r.choice((-50, 0, 40, 90, 300, 900, 4000))
            at = max(at, 0)
            dur = r.choice((200, 700, 1200, 3000, 9000))
            words = " ".join(r.choice(("ala", "ma", "kota", "psa", "tak", "Tak", "nie.")) for _ in range(r.choice((0, 1, 2, 4, 7, 150))))
            rows.append((rec, i, r.choice("ABC"), at, at + dur, words))
            at += dur
    return rows


def grouped(rows):
    out = OrderedDict()
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("kw", [{}, {"reach": 4, "below_ms": 1500, "other": True}])
def test_neighbour_vote(spark, kw):
    rows = lists(1)
    reach, below, other = kw.get("reach", 3), kw.get("below_ms", 1000), kw.get("other", False)
    want = []
    for rec, own in grouped(rows).items():
        labels = [r[2] for r in own]
        for i, r in enumerate(own):
            near = [labels[j] for j in range(max(0, i - reach), min(len(own), i + reach + 1)) if j != i]
            if r[4] - r[3] < below and near:
                best = max(dict.fromkeys(near), key=near.count)
                if near.count(best) >= max(2, len(near) // 2) and not (other and best == labels[i]):
                    labels[i] = best
        want += [(rec, r[1], s) for r, s in zip(own, labels, strict=True)]
    got = votes.neighbour_vote(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert sorted((r.recording_id, r.seg_id, r.speaker) for r in got) == sorted(want)


def test_votes_of_one_long_recording(spark):
    """40,000 rows of one recording, half of them short: the same as the loop, in chains of their own."""
    r = random.Random(9)
    rows = [(1, i, r.choice("AB"), 0, r.choice((300, 5000)) if i % 1000 > 40 else 300, "") for i in range(40_000)]
    labels = [x[2] for x in rows]
    for i, x in enumerate(rows):
        near = labels[max(0, i - 3) : i] + labels[i + 1 : i + 4]
        best = max(dict.fromkeys(near), key=near.count)
        if x[4] < 1000 and near.count(best) >= max(2, len(near) // 2):
            labels[i] = best
    got = votes.neighbour_vote(spark.createDataFrame(rows, SCHEMA)).orderBy("seg_id").toPandas()
    assert got.speaker.tolist() == labels and got.changed.tolist() == [x[2] != y for x, y in zip(rows, labels, strict=True)]


def test_bridges(spark):
    rows = lists(2)
    want = []
    for rec, own in grouped(rows).items():
        s = [r[2] for r in own]
        for i in range(1, len(own) - 1):
            if s[i - 1] == s[i + 1] and s[i] != s[i - 1] and own[i][3] - own[i - 1][4] < 500 and own[i + 1][3] - own[i][4] < 500:
                s[i] = s[i - 1]
        want += [(rec, r[1], v) for r, v in zip(own, s, strict=True)]
    got = votes.bridges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.recording_id, r.seg_id, r.speaker) for r in got) == sorted(want)


def test_translation_batches_and_chunks(spark):
    rows = lists(3)
    df = spark.createDataFrame(rows, SCHEMA)
    batches, chunks = [], []
    for rec, own in grouped(rows).items():
        b = n = c = 0
        for r in own:
            batches.append((rec, r[1], b))
            n, c = n + 1, c + len(r[5])
            if n >= 15 or c >= 3000:
                b, n, c = b + 1, 0, 0
        i = k = 0
        while i < len(own):
            first = max(0, i - 2)
            end = i
            size = lambda a, z: sum(len(own[j][5]) for j in range(a, z + 1))  # noqa: E731, B023
            while end + 1 < len(own) and (end - first + 1 < 3 or size(first, end) < 600):
                end += 1
            chunks.append((rec, k, first, end))
            i, k = end + 1, k + 1
    assert sorted(tuple(r) for r in x.translation_batches(df).collect()) == sorted(batches)
    assert sorted(tuple(r)[:4] for r in x.sliding_chunks(df).collect()) == sorted(chunks)


def test_topic_windows(spark):
    rows = lists(4)
    want = []
    for rec, own in grouped(rows).items():
        at = win = n = 0
        for r in own:
            if r[3] - at >= 5000 and n:
                win, at, n = win + 1, r[3], 0
            n += 1
            want.append((rec, win))
    got = x.topic_windows(spark.createDataFrame(rows, SCHEMA), 5000, most=1000).collect()
    assert sorted((r.recording_id, r.win_id, r.n) for r in got) == sorted({(a, b, want.count((a, b))) for a, b in want})


def test_sentence_fragments_and_filters(spark):
    rows = [(1, 0, "A", 0, 1000, "to jest"), (1, 1, "A", 1050, 2000, "koniec."), (1, 2, "A", 2050, 3000, "nowe"), (1, 3, "B", 3000, 4000, "inne"), (2, 0, "A", 0, 14_900, "długie"), (2, 1, "A", 14_950, 15_500, "za długie")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.recording_id, r.first_id): r.text for r in folds.sentence_fragments(df).collect()}
    assert got == {(1, 0): "to jest koniec.", (1, 2): "nowe", (1, 3): "inne", (2, 0): "długie", (2, 1): "za długie"}
    rows = [(1, 0, "A", 0, 1, "raz dwa trzy"), (1, 1, "A", 5, 6, "Raz dwa trzy"), (1, 2, "A", 7, 8, "raz dwa trzy"), (1, 3, "A", 9, 10, "nie nie nie nie nie nie"), (1, 4, "A", 11, 12, " "), (1, 5, "B", 13, 14, "raz dwa trzy"), (1, 6, "B", 13, 14, "cztery")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.seg_id for r in folds.without_repetitions(df).collect()) == [0, 6]
    assert sorted(r.seg_id for r in folds.without_near_duplicates(df).collect()) == [0, 3, 4, 5, 6]


def test_buffered_chunks(spark):
    rows = [(1, i, "AB"[i % 2], i * 10, i * 10 + 9, "w" * 300) for i in range(5)]
    got = folds.buffered_chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk_id").collect()
    assert [(r.segment_ids, r.start_ms, r.end_ms) for r in got] == [([0, 1, 2], 0, 29), ([0, 1, 2, 3, 4], 29, 49)]
    assert got[1].text.startswith("w" * 150 + " ") and got[1].start_ms == 29 and got[1].speaker == "A"
