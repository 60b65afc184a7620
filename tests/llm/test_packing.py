import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import packing as p
from confab.llm import wordids
from tests.llm.support import awkward, prose, table

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def tokens(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_plan(counts, window=2048):
    """Every piece of the histogram lands once, gapless; returns the padding."""
    plan = p.planned(counts, window)
    length = np.repeat(np.arange(window + 1), counts)
    nth = np.concatenate([np.arange(n) for n in counts]) if counts.sum() else np.zeros(0, np.int64)
    row, skip, n, seq, at = p.located(plan, length, nth)
    fill, cover = defaultdict(list), defaultdict(list)
    for r, s, k, q, o in zip(*(x.tolist() for x in (row, skip, n, seq, at)), strict=True):
        fill[q].append((o, k))
        cover[r].append((s, k))
    for r, own in cover.items():
        end = 0
        for s, k in sorted(own):
            assert s == end and k > 0
            end += k
        assert end == length[r]
    assert len(cover) == len(length)
    padding = 0
    for own in fill.values():
        end = 0
        for o, k in sorted(own):
            assert o == end
            end += k
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert len(fill) == plan.sequences() == (max(fill) + 1 if fill else 0)
    return padding


@pytest.mark.parametrize("kind", ["even", "short", "long", "one", "ones", "full", "few", "none", "skewed"])
def test_plans_cover_every_piece_with_little_padding(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 2048, 30_000), "short": rng.integers(1, 300, 30_000), "long": rng.integers(1100, 2048, 5_000), "one": np.full(4_001, 1500), "ones": np.ones(10_000, np.int64),
        "full": np.full(50, 2048), "few": rng.integers(1, 2048, 7), "none": np.zeros(0, np.int64), "skewed": np.concatenate([np.full(20_000, 700), rng.geometric(0.004, 20_000).clip(1, 2047)]),
    }[kind]
    counts = np.bincount(lengths, minlength=2049)
    assert check_plan(counts) <= 0.01 * lengths.sum()


def test_plan_size_does_not_follow_the_counts():
    counts = np.zeros(2049, np.int64)
    counts[1:2048] = np.random.default_rng(1).integers(0, 10**9, 2047)
    plan = p.planned(counts)
    assert len(plan.whole) < 60_000 and (plan.whole[:, 4] > 0).all()


def test_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(4)
    a, h = rng.integers(0, 3, (24, 90)).astype(float), rng.random(24) * 100
    x = p.least_squares(a, h)
    g = a.T @ (h - a @ x)
    assert (x >= 0).all() and g.max() < 1e-5 * np.abs(a.T @ h).max() and np.abs(g[x > 1e-9]).max() < 1e-5 * np.abs(a.T @ h).max()


def test_combinations_fill_the_window():
    got = p.combinations(12)
    assert len(got) == len(set(got)) and all(sum(c) == 12 and len(c) <= 3 and list(c) == sorted(c, reverse=True) for c in got)
    assert set(got) == {tuple(sorted(c, reverse=True)) for c in [(12,), *((i, 12 - i) for i in range(1, 12)), *((i, j, 12 - i - j) for i in range(1, 12) for j in range(1, 12 - i))]}


def documents():
    r = random.Random(8)
    rows = [*awkward(), (None, "no id", None), (None, None, None), (900, prose(30, 9000), "a")]
    return rows + [(2000 + i, prose(100 + i, r.choice([3, 40, 200, 700])), "b") for i in range(150)]


@pytest.mark.parametrize("waste", [16, -1])
def test_pieces_cover_documents_and_sequences(spark, monkeypatch, waste):
    rows = documents()
    monkeypatch.setattr(p, "FEW", 20_000 if waste > 0 else 0)  # both ways to look up what is cut
    if waste < 0:
        monkeypatch.setattr(p, "shallow", lambda counts, window: ([], counts.copy()))
    pieces, _ = p.packed(table(spark, rows).repartition(4), PATH, waste=waste)
    got = pieces.collect()
    want = Counter((d, tuple(ids)) for (d, *_), ids in zip(rows, tokens([t for _, t, _ in rows]), strict=True))
    by = {}
    for g in got:
        by.setdefault((g.part, g.row), []).append(g)
    ids_of = defaultdict(list)
    for d, ids in want.elements():
        ids_of[d, len(ids)].append(ids)
    fill, seen = defaultdict(list), Counter()
    for own in by.values():
        own.sort(key=lambda g: g.start)
        assert [g.start for g in own] == [0, *np.cumsum([g.length for g in own]).tolist()][:-1] and sum(g.length for g in own) == own[0].doc_tokens
        match = [ids for ids in ids_of[own[0].doc_id, own[0].doc_tokens] if all(zlib.crc32(np.array(ids[g.start : g.start + g.length], "<u4").tobytes()) == g.ids_crc32 for g in own)]
        assert match
        seen[own[0].doc_id, match[0]] += 1
        for g in own:
            fill[g.sequence_id].append((g.offset, g.length))
    assert seen == want
    padding = 0
    for own in fill.values():
        ends = np.cumsum([k for _, k in sorted(own)]).tolist()
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert padding <= 0.02 * sum(len(i) for _, i in want.elements())


def test_sequences_hold_the_ids(spark):
    rows = [(i, prose(i, 30 + 17 * i), "a") for i in range(60)]
    got = p.sequences(table(spark, rows), PATH, pad=7).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) == r.n_tokens and r.n_tokens & (r.n_tokens - 1) == 0 for r in got)
    assert Counter(i for r in got for i in r.ids[: r.n_tokens]) == Counter(i for ids in tokens([t for _, t, _ in rows]) for i in ids)
    assert {d for r in got for d in r.doc_ids} == set(range(60))


def test_empty_table_and_clashing_columns(spark):
    assert p.packed(table(spark, []), PATH)[0].collect() == []
    docs = table(spark, [(1, None, None)]).withColumns({c: F.lit(c) for c in ("part", "row", "crcs", "ids", "start", "length", "nth", "cut")})
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in p.packed(docs, PATH)[0].collect()] == [(1, 0, 1, 1, 0, 0)]
    assert p.packed(docs, PATH, end=None)[0].collect() == []


def test_whole_texts_where_words_may_join(tmp_path):
    """Ids equal the tokenizer's for each file; only files that drop white space are encoded by word."""
    config = json.load(open(PATH))
    kinds = {"own": config, "spaced": config | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "normalizer": None}, "joined": config | {"pre_tokenizer": None}, "posted": config | {"normalizer": {"type": "Prepend", "prepend": "x"}}}
    import pyarrow as pa

    texts = ["One TWO  three", None, "", " a\tb\n", "it's <|endoftext|> x<|endoftext|>y", "Σας É ́x  y", "x" * 700 + " z", prose(1, 500)]
    for name, c in kinds.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(c))
        enc = wordids.WordIds(str(path), most=20)
        assert enc.by_word == (name in ("own", "spaced"))
        for own in (texts, texts[::-1], texts[1:3]):
            ids, ends = enc.encode(pa.array(own, pa.string()))
            each = [enc.tok.encode(t or "", add_special_tokens=False).ids for t in own]
            assert ids.tolist() == [i for e in each for i in e] and ends.tolist() == np.cumsum([len(e) for e in each]).tolist()
    assert wordids.WordIds(public.path("byte_bpe_50k.json")).by_word is False


def test_parts_of_words_have_the_ids_of_the_words():
    import pyarrow as pa

    r, enc = random.Random(6), wordids.WordIds(PATH, most=50)
    assert enc.by_part and not wordids.folds_letters(json.load(open(PATH)) | {"normalizer": None})
    odd = [*"aZst'.,-9 \té\u0301İΣ<|>", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "\u00a0"]
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(12))) for _ in range(3000)]
    for own in (texts, [t for t in texts if "<|end" not in t.lower()]):
        ids, ends = enc.encode(pa.array(own))
        each = [enc.tok.encode(t, add_special_tokens=False).ids for t in own]
        assert ids.tolist() == [i for e in each for i in e] and ends.tolist() == np.cumsum([len(e) for e in each]).tolist()
    refused = ["[a-z ]+", "\\S+ ?", "[\\p{L}]+[.]", "a|", "[^\\p{L}]+"]
    assert not any(wordids._drops_blanks({"type": "Split", "behavior": "Removed", "invert": True, "pattern": {"Regex": x}}) for x in refused)
