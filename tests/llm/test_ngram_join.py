import random

import numpy as np

from confab.llm import ngram_join as nj
from tests.llm.support import LOWER, awkward, prose, table, words


def brute(rows):
    sets = []
    for d, t, _ in rows:
        w = words((t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, a) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(i) and sets[j][0] is not None]
        out.append((d, len(a), min(ids) if ids else d))
    return sorted(out, key=repr)


def check(spark, rows, **kw):
    got = nj.near_groups(table(spark, rows), **kw)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_awkward_texts(spark):
    check(spark, [*awkward(), (None, prose(1, 120), None), (None, "alone here", None)])


def mutated(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
    return " ".join(w)


def test_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nj, "COMMON", 5)
    r = random.Random(4)
    rows = []
    for g in range(6):
        base = prose(900 + g, 100)
        rows += [(1000 * g + i, mutated(r, base, r.randrange(7)), None) for i in range((3, 40, 2, 15, 8, 1)[g])]
    rows += [(9000 + i, prose(1, 40) + " " + prose(2000 + i, 60), None) for i in range(30)]  # share a passage, don't link
    check(spark, rows)


def test_very_common_shingles_of_many_groups(spark):
    r, common = random.Random(8), prose(3000, 300)
    rows = []
    for g in range(14):
        base = (common if g % 3 else " ".join(common.split()[:150])) + " " + prose(3100 + g, 62)
        rows += [(100 * g + i, mutated(r, base, i), None) for i in range(3)]
    check(spark, rows, cell=4)
    check(spark, rows, cell=4, buckets=3000)
    check(spark, rows, weight=700)


def test_sets_of_one_digest_keep_apart(spark, monkeypatch):
    sets = nj.shingle_sets

    def weak(data, offsets, k=5):
        all_, at, digest = sets(data, offsets, k)
        digest[:, 0] %= 7
        return all_, at, digest

    monkeypatch.setattr(nj, "shingle_sets", weak)
    check(spark, awkward())


def test_empty_table(spark):
    assert nj.near_groups(table(spark, [])).collect() == []


def test_trie_finds_the_components_of_all_links():
    r = np.random.default_rng(6)
    for _ in range(40):
        pool = np.sort(r.choice(1 << 40, 60, replace=False)).astype(np.uint64)
        sets = [np.sort(r.choice(pool, r.integers(20, 60), replace=False)) for _ in range(14)] + [np.delete(pool, r.choice(60, r.integers(1, 9), replace=False)) for _ in range(8)]
        sizes = np.array([len(s) + int(r.integers(0, 3)) for s in sets])
        links = nj.Trie(sets, sizes).links(np.arange(len(sets)))
        label = list(range(len(sets)))

        def merge(label, a, b):
            return [label[a] if x == label[b] else x for x in label]

        want = label
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                    want = merge(want, a, b)
        for a, b in links:
            label = merge(label, a, b)
        same = lambda x: {frozenset(i for i, v in enumerate(x) if v == u) for u in x}
        assert same(label) == same(want)


def test_parities_never_rule_out_a_link():
    r = np.random.default_rng(7)
    for _ in range(30):
        pool = r.choice(1 << 53, 400, replace=False).astype(np.uint64)
        sets = [r.choice(pool[: r.integers(30, 400)], r.integers(5, 30), replace=False) for _ in range(8)]
        for base in (pool[:200], pool[200:230]):
            sets += [np.delete(base, r.choice(len(base), r.integers(0, len(base) // 6), replace=False)) for _ in range(5)]
        s = np.array([len(x) for x in sets])
        n, label = s + r.integers(0, 3, len(s)), r.integers(0, 6, len(s))
        may = nj.feasible(n, s, label, [nj.parity(x) for x in sets])
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if label[a] != label[b] and 100 * both >= 80 * (n[a] + n[b] - both):
                    assert may[a] and may[b]
