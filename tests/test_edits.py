"""Pairs of words that meet by equal joins, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import edits as e
from confab.operators import retrieval as r


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def vocabulary(seed, n):
    """Words of 1 to 60 letters with few letters, many of them edits of others."""
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        if out and rnd.random() < 0.6:
            w = list(rnd.choice(sorted(out)))
            for _ in range(rnd.randrange(1, 5)):
                i = rnd.randrange(len(w) + 1)
                w[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c"])
        else:
            w = [rnd.choice("abcde") for _ in range(rnd.choice([1, 3, 4, 5, 6, 8, 11, 14, 15, 16, 20, 31, 34, 60]))]
        if w:
            out.add("".join(w))
    return sorted(out)


@pytest.fixture(scope="module")
def both(spark):
    words, asked = vocabulary(1, 500), vocabulary(2, 120) + vocabulary(1, 500)[::7]
    asked = sorted(set(asked))
    return words, asked, spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(q,) for q in asked], "q string")


def test_keyword_pairs_equal_all_pairs(both):
    words, asked, w, q = both
    want = {}
    for a in words:
        for b in asked:
            d = distance(a, b)
            sim = 1.0 if a.startswith(b) or b.startswith(a) else 1 - d / max(len(a), len(b)) if len(b) >= 4 and len(a) >= 3 and d <= 2 else 0
            if sim > 0.6:
                want[a, b] = sim
    got = {(x.w, x.q): x.sim for x in r.keyword_pairs(w, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_match_pairs_equal_all_pairs(both):
    words, asked, w, q = both
    got = {(x.w, x.q): (x.m.o, x.m.s) for x in r.match_pairs(w, q).collect()}
    keys = {}
    from confab.functions import text as t

    for x in w.union(q).distinct().select("w", t.phonetic_key(F.col("w")).alias("k")).collect():
        keys[x.w] = x.k
    for a in words:
        for b in asked:
            sim = 1 - distance(a, b) / max(len(a), len(b))
            if a.startswith(b):
                assert got.get((a, b)) == (3, 1.0)
            elif len(b) >= 4 and len(a) >= 3 and sim >= 0.72:
                assert got[a, b][0] == 2 and abs(got[a, b][1] - sim) < 1e-12
            elif len(b) >= 4 and len(a) >= 4 and len(keys[b]) >= 2 and keys[a] == keys[b]:
                assert got[a, b] == (1, 0.7)
            else:
                assert (a, b) not in got


def test_what_meets_is_near_what_matches(spark):
    """On words as texts have them, candidates are few times the matches, far from a share of all pairs."""
    rnd = random.Random(4)
    parts = ["ver", "heit", "tion", "ing", "un", "ter", "ment", "ble", "or", "an", "re", "th", "sch", "a", "e"]
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(2, 5))) for _ in range(3000)})
    w, q = spark.createDataFrame([(x,) for x in words], "w string"), spark.createDataFrame([(x,) for x in words[::3]], "q string")
    most = lambda n: F.when(n < 6, 1).otherwise(2)
    met = e._keyed(w.filter(F.length("w") <= e.SHORT), "w", most).join(e._keyed(q.filter(F.length("q") <= e.SHORT), "q", most), "_k").select("w", "q").distinct().count()
    matched = e.edit_pairs(w, q, most).count()
    assert matched <= met * 1.01 + 50 and met <= 4 * matched and met < 0.02 * len(words) * len(words[::3])


def test_no_words(spark):
    none = spark.createDataFrame([], "w string"), spark.createDataFrame([], "q string")
    assert r.keyword_pairs(*none).collect() == [] and r.match_pairs(*none).collect() == []
