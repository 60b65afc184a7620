"""The whole diarization against its passes as loops."""

import random
from collections import Counter

import pytest

from confab.operators import flows
from confab.plans import flow_queries
from confab.sources import conversations as c

SEGS = "recording_id long, seg_id int, start_ms long, end_ms long, text string"
TURNS = "recording_id long, turn_idx int, speaker_raw string, start_ms long, end_ms long"
WORDS = "recording_id long, seg_id int, word_idx int, word string, start_ms long"


def passes(segs, turns, words):
    """One recording: segments (id, start, end, text), turns (start, end, raw), words {id: [(start, word)]}."""
    cuts = sorted((a[1] + b[0]) // 2 for a, b in zip(turns, turns[1:]))
    pieces = []
    for i, s, e, text in segs:
        inner = sorted({t for t in cuts if s < t < e})
        if not inner:
            pieces.append([s, e, text])
            continue
        for j, (a, b) in enumerate(zip([s, *inner], [*inner, e])):
            if b - a < 100:
                continue
            own = [w for t, w in words.get(i, []) if a <= t < b]
            now = " ".join(w.strip() for w in own).strip() if own else text if j == 0 else ""
            if now.strip() or j == 0:
                pieces.append([a, b, now])
    names, labels, last, time = {}, [], None, {}
    for a, b, _ in pieces:
        cover = {}
        for s, e, raw in turns:
            if min(b, e) > max(a, s):
                cover[raw] = cover.get(raw, 0) + min(b, e) - max(a, s)
        best = max(cover, key=cover.get) if cover else None
        if best is not None and cover[best] * 100 >= (b - a) * (1 if b - a < 500 else 5):
            last = names.setdefault(best, f"GŁOS_{len(names) + 1:02d}")
        labels.append(last or "GŁOS_01")
        time[labels[-1]] = time.get(labels[-1], 0) + b - a
    new = {x: f"GŁOS_{i + 1:02d}" for i, x in enumerate(sorted(time, key=time.get, reverse=True))}
    labels = [new[x] for x in labels]
    for i, (a, b, _) in enumerate(pieces):
        near = labels[max(0, i - 3) : i] + labels[i + 1 : i + 4]
        if b - a < 1000 and near:
            top, n = Counter(near).most_common(1)[0]
            if n >= max(2, len(near) // 2):
                labels[i] = top
    out = []
    for n, ((a, b, text), who) in enumerate(zip(pieces, labels)):
        if not text.strip():
            continue
        p = out[-1] if out else None
        if p and p[1] == who and a - p[3] <= 100 and b - p[2] <= 15_000 and p[4].strip()[-1] not in ".!?…;":
            p[3], p[4] = b, f"{p[4].strip()} {text.strip()}"
        else:
            out.append([n, who, a, b, text])
    return [(*x[:4], x[4].strip()) for x in out]


def made(seed):
    r, segs, turns, words = random.Random(seed), [], [], []
    for rec in range(25):
        at = 0
        for i in range(r.randrange(1, 20)):
            at += r.choice([0, 0, 40, 90, 700, 5000])
            dur = r.choice([60, 300, 900, 2500, 9000])
            text = r.choice(["", " ", "tak.", "no to jest", "raz dwa trzy cztery; pięć", "koniec!"])
            segs.append((rec, i, at, at + dur, text))
            own = text.split()
            if r.random() < 0.8:
                words += [(rec, i, k, w, at + k * dur // len(own)) for k, w in enumerate(own)]
            at += dur
        t = r.choice([0, 300])
        for k in range(0 if rec == 3 else r.randrange(1, 9)):
            e = t + r.choice([150, 800, 4000, 9000])
            turns.append((rec, k, r.choice("xyz"), t, e))
            t = max(t + 1, e + r.choice([-400, 0, 30, 600, 3000]))
    return segs, turns, words


@pytest.mark.parametrize("timed", [True, False])
def test_equals_the_passes(spark, timed):
    segs, turns, words = made(7)
    got = flows.diarized_whole(spark.createDataFrame(segs, SEGS), spark.createDataFrame(turns, TURNS), spark.createDataFrame(words, WORDS) if timed else None)
    want = []
    for rec in {s[0] for s in segs}:
        own = {}
        for x in words if timed else []:
            if x[0] == rec:
                own.setdefault(x[1], []).append((x[4], x[3]))
        want += [(rec, *x) for x in passes([s[1:] for s in segs if s[0] == rec], [(t[3], t[4], t[2]) for t in turns if t[0] == rec], own)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_query_equals_the_passes_on_whole_tables(spark):
    conv = c.table(spark, "/root/testdata/sf0.001", "conversations")
    segs = c.segments(conv)
    turns, words = c.turns(segs, conv), flow_queries._timed_words(segs)
    rows = {}
    for name, df in (("s", segs.orderBy("seg_id")), ("t", turns.orderBy("start_ms", "turn_idx")), ("w", words.orderBy("word_idx"))):
        for x in df.collect():
            rows.setdefault(x.recording_id, {"s": [], "t": [], "w": {}})
            own = rows[x.recording_id]
            if name == "s":
                own["s"].append((x.seg_id, x.start_ms, x.end_ms, x.text))
            elif name == "t":
                own["t"].append((x.start_ms, x.end_ms, x.speaker_raw))
            else:
                own["w"].setdefault(x.seg_id, []).append((x.start_ms, x.word))
    want = [(rec, *x) for rec, own in rows.items() for x in passes(own["s"], own["t"], own["w"])]
    assert sorted(map(tuple, flow_queries.QUERIES["diarization_plan"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)
