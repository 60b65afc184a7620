import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from confab.llm import resampling as r
from tests.llm.support import LOWER, awkward, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def noise(doc_id):
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def brute(docs, bench):
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in bench for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in set(s) | set(t)}
    rows = [(d, len(w), len(f), sum(gain[b] for b in f)) for d, w, f in own]
    rows = [(d, n, k, w, w + noise(d)) for d, n, k, w in rows]
    able = sorted((i for i, x in enumerate(rows) if x[1] >= 20), key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(able[: 5 * len(able) // 100])}
    return [(d, k, w, s_, rank.get(i)) for i, (d, _, k, w, s_) in enumerate(rows)]


def texts():
    rnd = random.Random(2)
    odd = ["Naïve Ünïcode, 漢字 and 😀 x\u0000y ß42", "a", "a b", "A-B_c 9!", "é" * 300 + " " + "z" * 200 + " q", "", None]
    rows = [(i, t) for i, t in enumerate(odd)] + [(d, t) for d, t, _ in awkward()]
    rows += [(5000 + i, prose(i, rnd.randrange(10, 60))) for i in range(900)]
    return rows + [(None, prose(77, 40)), (None, prose(77, 40)), (6000, prose(78, 40)), (6000, prose(78, 40)), (6000, prose(79, 40))]


def run(spark, docs, bench, **kw):
    d = table(spark, [(*x, None) for x in docs]).withColumnRenamed("source", "rank").repartition(6)
    gain = r.gains(r.bucket_counts(d), r.bucket_counts(spark.createDataFrame([(x,) for x in bench], "text string")))
    out = r.drawn(r.weighted(d, gain), **kw).select("doc_id", "n_features", "weight", "score", "rank")
    return [tuple(x) for x in out.collect()]


BENCH = [prose(500 + i, 80) for i in range(30)] + [None, "", "One more, one MORE"]


@pytest.mark.parametrize("kw", [{}, {"aim": 5, "fan": 2}, {"aim": 1, "fan": 3}])
def test_equals_brute_force(spark, kw):
    docs = texts()
    got, want = run(spark, docs, BENCH, **kw), brute(docs, BENCH)
    assert Counter(x[:4] for x in got) == Counter(x[:4] for x in want)
    assert sorted((x[4], x[0], x[3]) for x in got if x[4]) == sorted((x[4], x[0], x[3]) for x in want if x[4])


@pytest.mark.parametrize("percent", [1, 40, 100])
def test_other_shares_and_hot_ids(spark, percent):
    """A third of all rows is one id and text; whatever share is drawn, ranks are gapless and in order."""
    rows = [(i, 30, (i * 37) % 50) for i in range(400)] + [(7, 30, 25)] * 200 + [(None, 30, 25)] * 3 + [(900, 19, 99)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(7)
    got = r.drawn(df, percent=percent, aim=20, fan=4).collect()
    assert Counter((x.doc_id, x.n_words, x.score) for x in got) == Counter(rows)
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[2], x[0] is None, x[0] or 0))
    drawn = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert [x["rank"] for x in drawn] == list(range(1, percent * len(able) // 100 + 1))
    assert [(x.doc_id, x.score) for x in drawn] == [(x[0], x[2]) for x in able[: len(drawn)]]


def test_empty_and_tiny_tables(spark):
    assert run(spark, [], []) == []
    assert sorted(run(spark, [(1, None), (2, "a b")], [])) == brute([(1, None), (2, "a b")], [])
    assert {x[4] for x in run(spark, [(1, prose(1, 30)), (2, "a")], BENCH)} == {None}


def test_tournament_merges_and_stops():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 7, 40):
        runs = [sorted(rnd.randrange(100) for _ in range(rnd.randrange(12))) for _ in range(n)]
        whole = sorted(x for run_ in runs for x in run_)
        for most in (None, 0, 3, 1000):
            assert r.merged(runs, most, fan=4) == whole[:most]


def test_crcs_of_runs():
    text = ("Ab " * 3 + "x" * 130 + " é漢 " + "y" * 64 + " " + "z" * 65 + " end").encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    n, found = r.feature_buckets(data, offsets)
    w, f = features(text.decode())
    assert n.tolist() == [len(w)] * 2
    assert [b for own, at in found for b in own[at[0] : at[1]].tolist()] == f and all((own[: at[1]] == own[at[1] :]).all() for own, at in found)
