import random

import numpy as np

from confab.llm import substring_dedup as sd
from tests.llm.support import awkward, prose, table, words


def brute(rows, span=sd.SPAN):
    """Equal ids and texts are one document; the cases here have no equal ids with shared spans."""
    seen, out = set(), {}
    for d, t in sorted({(d if d is not None else 1 << 62, t or "") for d, t, _ in rows}):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in seen:
                gone[i : i + span] = [True] * span
            seen.add(key)
        out[d, t] = " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)
    return out


def check(spark, rows):
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.kept_text, r.n_words, r.n_removed) for r in sd.without_repeats(table(spark, rows)).collect())
    want = brute(rows)
    assert got == sorted((d if d is not None else 1 << 62, *want[d if d is not None else 1 << 62, t or ""]) for d, t, _ in rows)


def test_awkward_texts(spark):
    check(spark, [*awkward(), (None, prose(1, 120), None)])


def test_passages_in_many_places(spark):
    r = random.Random(8)
    passages = [prose(50 + i, 60).split() for i in range(3)]
    rows = []
    for i in range(60):
        text = prose(100 + i, r.randrange(5, 80)).split()
        for _ in range(r.randrange(3)):
            p = passages[r.randrange(3)]
            a = r.randrange(30)
            at = r.randrange(len(text) + 1)
            text[at:at] = p[a : a + r.randrange(10, 40)]
        rows.append((i, " ".join(text), None))
    rows += [(100, " ".join(["same"] * 500), None), (101, " ".join(["same"] * 30), None)]
    check(spark, rows)


def test_unbranched_passages_are_one_row_and_branches_are_not(spark):
    passage = prose(70, 2000)
    rows = [(i, f"{prose(80 + i, 40)} {passage} {prose(90 + i, 40)}", None) for i in range(3)]
    keyed = sd._keyed(table(spark, rows), "doc_id", "text")
    kinds = {r.kind: r["count"] for r in sd.repeated_anchors(keyed).groupBy("kind").count().collect()}
    assert kinds[2] > 200 and kinds.get(0, 0) <= 4
    spans = sd.repeated_spans(keyed).collect()
    assert sorted((r.did, [tuple(x) for x in r.spans]) for r in spans) == [(i, [(40, 2040)]) for i in (1, 2)]
    check(spark, rows)


def test_spans_whose_texts_differ_stay(spark, monkeypatch):
    """With window hashes of 3 bits, false places abound: no word that is not repeated may go."""

    class Weak(sd.Paths):
        def __init__(self, *a):
            super().__init__(*a)
            if len(self.doc):
                self.anchor, self.windows, self.content = (x & np.uint64(7) for x in (self.anchor, self.windows, self.content))
                self.next = self.content

    monkeypatch.setattr(sd, "Paths", Weak)
    rows = [(i, prose(300 + i, 60), None) for i in range(20)] + [(50, prose(301, 60), None)]
    assert all(r.n_removed == 0 for r in sd.without_repeats(table(spark, rows)).filter("doc_id < 50").collect())


def test_empty_table(spark):
    assert sd.without_repeats(table(spark, [])).collect() == []


def test_sliding_argmin_is_leftmost():
    v = np.array([3, 1, 1, 5, 0, 0, 7, 2, 2, 2], np.uint64)
    for w in range(1, 8):
        assert sd.sliding_argmin(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]
