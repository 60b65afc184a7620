"""Moments of blocks against the whole audio of a speaker, and merges that come from sound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.operators import profiles, voices

SEGS = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long, text string"
AUDIO = "recording_id long, start long, samples array<float>"
RATE = 1000


def blocks(recording, x, cuts):
    return [(recording, int(a), [float(v) for v in x[a:z]]) for a, z in zip([0, *cuts], [*cuts, len(x)], strict=True)]


def whole(x, segs, speaker, most=90_000):
    return np.concatenate([x[a * RATE // 1000 : z * RATE // 1000] for _, _, s, a, z, _ in segs if s == speaker])[:most]


@pytest.mark.parametrize("block", [2048, 5000, 65_536])
def test_moments_of_blocks_are_those_of_the_whole(spark, block):
    rng = np.random.default_rng(block)
    x = (rng.normal(size=130_000) * np.repeat(rng.uniform(0.1, 1, 130), 1000)).astype(np.float32)
    edges = np.sort(rng.choice(129_000, 41, replace=False))
    segs = [(1, i, "ab"[int(rng.integers(2))], int(a), int(z), "") for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
    segs += [(1, 99, "c", 100, 300, ""), (1, 100, "d", 0, 129_500, ""), (1, 101, None, 0, 10, ""), (1, 102, "e", 50, 50, "")]
    cuts = sorted(int(c) for c in rng.choice(129_000, 30, replace=False))
    df, audio = spark.createDataFrame(segs, SEGS), spark.createDataFrame(blocks(1, x, cuts), AUDIO)
    pieces = voices.stream_pieces(voices.speaker_streams(df, RATE), audio, block)
    got = {r.speaker: np.array(r.vector) for r in voices.voice_vectors(voices.frame_moments(pieces, RATE, 13, block)).collect()}
    assert set(got) == set("abcd")
    for s, v in got.items():
        np.testing.assert_allclose(v, profiles.mfcc_vector(whole(x, segs, s).astype(float), RATE, 13), rtol=1e-6, atol=1e-6)


def voice(seed, n, colour):
    """Noise through two poles: one colour is one voice."""
    noise, y = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for i in range(2, n):
        y[i] = noise[i] + 2 * 0.9 * np.cos(colour) * y[i - 1] - 0.81 * y[i - 2]
    return y / np.abs(y).max()


def test_merges_come_from_the_sound(spark):
    """Speakers 0 and 2 of recording 1 are one voice, 1 is another; in recording 2 the two that are alike speak at once; 3 has too little."""
    segs, audio = [], []
    for rec in (1, 2, 3):
        n = 20_000 if rec < 3 else 4000
        parts = [("s0", 0.5), ("s1", 2.4), ("s2", 0.5)]
        x = np.concatenate([voice(rec * 10 + i, n, c) for i, (_, c) in enumerate(parts)])
        audio += blocks(rec, x, [7000] if rec < 3 else [3000])
        segs += [(rec, i, s, i * n, (i + 1) * n + (500 if rec == 2 and s == "s0" else 0), "t") for i, (s, _) in enumerate(parts)]
    segs[3 + 2] = (2, 2, "s2", 20_200, 60_000, "t")
    df, heard = spark.createDataFrame(segs, SEGS), spark.createDataFrame(audio, AUDIO)
    pairs = {(r.recording_id, r.a, r.b): r for r in voices.voice_pairs(df, heard, rate=RATE, block=4096).collect()}
    assert {k[0] for k in pairs} == {1, 2}
    x = np.concatenate([voice(10 + i, 20_000, c) for i, c in enumerate((0.5, 2.4, 0.5))]).astype(np.float32).astype(float)
    v = [profiles.mfcc_vector(x[i * 20_000 : (i + 1) * 20_000], RATE) for i in range(3)]
    for (i, j) in ((0, 1), (0, 2), (1, 2)):
        assert pairs[1, f"s{i}", f"s{j}"].cosine == pytest.approx(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]), abs=1e-4)
    assert pairs[1, "s0", "s2"].cosine >= 0.99 > pairs[1, "s0", "s1"].cosine
    assert pairs[2, "s0", "s2"].overlap and not pairs[1, "s0", "s2"].overlap
    got = {(r.recording_id, r.seg_id): r.speaker for r in voices.merged_voices(df, heard, rate=RATE, block=4096).collect()}
    assert got[1, 0] == got[1, 2] != got[1, 1] and len({got[2, i] for i in range(3)}) == 3 and len({got[3, i] for i in range(3)}) == 3
    told = spark.createDataFrame([(1, "s0", "s2")], "recording_id long, a string, b string")
    kept = {r.speaker for r in voices.merged_voices(df.filter("recording_id = 1"), heard, conflicts=told, rate=RATE, block=4096).collect()}
    assert len(kept) == 3


def test_no_audio(spark):
    segs, audio = spark.createDataFrame([(1, 0, "a", 0, 9000, "t"), (1, 1, "b", 9000, 20_000, "t")], SEGS), spark.createDataFrame([], AUDIO)
    assert voices.voice_pairs(segs, audio, rate=RATE).count() == 0
    assert voices.merged_voices(segs, audio, rate=RATE).count() == 2
    assert voices.voice_pairs(segs.limit(0), audio, rate=RATE).count() == 0


def test_samples_are_not_broadcast(spark):
    """Arrays made in a plan are of unknown size: the join must not send them through the driver."""
    segs = spark.createDataFrame([(1, 0, "a", 0, 9000, "t")], SEGS)
    audio = spark.range(1).select(F.lit(1).cast("long").alias("recording_id"), F.lit(0).cast("long").alias("start"), F.transform(F.sequence(F.lit(1), F.lit(9000)), lambda i: i.cast("float")).alias("samples"))
    pieces = voices.stream_pieces(voices.speaker_streams(segs, RATE), audio, 4096)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert sorted((r.at, len(r.samples)) for r in pieces.collect()) == [(0, 9000)]


def test_query_against_whole_audio(spark):
    """Similarities of the query, from the whole sound of each speaker."""
    import os

    from confab.plans import flow_queries
    from confab.plans.segment_queries import _base

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    segs = flow_queries._in_a_row(_base(spark, sf)[1]).orderBy("recording_id", "seg_id").collect()
    sound = {}
    for r in segs:
        letters = [[np.sin(i * (0.2 + len(ch) * (ord(ch) % 32) / 13)) for i in range(60)] for ch in r.text]
        sound.setdefault((r.recording_id, r.speaker), []).append(np.concatenate(letters)[: r.end_ms - r.start_ms])
    x = {k: np.concatenate(v) for k, v in sound.items()}
    v = {k: profiles.mfcc_vector(a[:90_000].astype(np.float32).astype(float), RATE) for k, a in x.items() if len(a[:90_000]) >= 5 * RATE}
    want = {(r, a, b): v[r, a] @ v[r, b] / np.linalg.norm(v[r, a]) / np.linalg.norm(v[r, b]) for r, a in v for q, b in v if q == r and a < b}
    got = {(r.recording_id, r.a, r.b): r.cosine for r in flow_queries.QUERIES["voice_pairs"](spark, sf).collect()}
    assert set(got) == set(want) and len(got) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in got)
    assert flow_queries.QUERIES["merged_voices"](spark, sf).count() == len(segs)


def test_sources_move_instead_of_samples(spark):
    """Samples that can be made of a source are made after the shuffles, and are those of a whole audio table."""
    rng = np.random.default_rng(5)
    edges = np.sort(rng.choice(60_000, 21, replace=False))
    segs = [(1, i, "ab"[i % 2], int(a), int(z), "") for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
    sound = lambda seed: F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.sin(i * i * seed / 7919).cast("float"))
    sources = spark.createDataFrame([(1, k * 15_000, 15_000, k + 1) for k in range(4)], "recording_id long, start long, n int, source int")
    df, whole_audio = spark.createDataFrame(segs, SEGS), sources.select("recording_id", "start", F.slice(sound(F.col("source")), 1, F.col("n")).alias("samples"))
    streams = voices.speaker_streams(df, RATE)
    made = voices.frame_moments(voices.stream_pieces(streams, sources, 5000, True), RATE, 13, 5000, sound)
    plan = made._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("FlatMapGroupsInPandas") :]
    assert 0 < plan.index("AS samples") < min(plan.index(x) for x in ("Sort ", "Exchange "))  # from the groups down: made above what sorts and deals
    rows = lambda moments: {(r.speaker, r.i): (r.heard, r.n, r.s, r.q) for r in moments.collect()}
    got, want = rows(made), rows(voices.frame_moments(voices.stream_pieces(streams, whole_audio, 5000), RATE, 13, 5000))
    assert set(got) == set(want) and len(got) == 2 * 39
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_queries_move_texts_instead_of_sound(spark):
    """The table that the queries give the operator holds no samples."""
    from confab.plans import flow_queries

    segs = spark.createDataFrame([(1, 0, "a", 0, 900, "some text"), (1, 1, "b", 0, 25_000, "zażółć"), (1, 2, "b", 900, 910, "x")], SEGS)
    rows = flow_queries._voices(lambda own, audio, rate, sound=None: audio.withColumn("made", F.size(sound(F.col("source")))))(segs)
    assert not [name for name, kind in rows.dtypes if kind.startswith("array")]
    assert sorted((r.start, r.n, r.made) for r in rows.collect()) == [(0, 540, 540), (900, 360, 360), (25_900, 10, 60)]


def long_speakers(spark):
    """Two speakers whose voices are one for 90 s; then a's becomes another, and b stops. c is a's later voice."""
    parts = [("a", 0.5, 95_000), ("b", 0.5, 60_000), ("a", 2.4, 150_000), ("b", 0.5, 30_000), ("c", 2.4, 40_000)]
    ends = np.cumsum([n for _, _, n in parts])
    segs = [(1, i, s, int(z) - n, int(z), "t") for i, ((s, _, n), z) in enumerate(zip(parts, ends, strict=True))]
    x = np.concatenate([voice(i, n, c) for i, (_, c, n) in enumerate(parts)]).astype(np.float32)
    cuts = list(range(50_000, int(ends[-1]), 50_000))
    return x, segs, spark.createDataFrame(segs, SEGS), spark.createDataFrame(blocks(1, x, cuts), AUDIO)


def test_merges_hear_the_whole_audio(spark):
    """Speakers that are alike in their first 90 s only are not merged; with a bound of 90 s they are."""
    x, segs, df, audio = long_speakers(spark)
    assert sum(z - a for _, _, s, a, z, _ in segs if s == "a") > 2 * 90_000
    merged = lambda **kw: {r.seg_id: r.speaker for r in voices.merged_voices(df, audio, rate=RATE, **kw).collect()}
    got = merged()
    assert set(got) == set(range(5)) and got[0] == got[2] != got[1] == got[3]
    cut = merged(most_s=90.0)
    assert cut[0] == cut[1]


def test_pairs_hear_the_end_of_the_texts(spark):
    """The query's similarities are those of all that a speaker says: texts that come after 90 s of the speaker's count."""
    from confab.plans import flow_queries

    said = [("a", "aei" * 130), ("b", "aei" * 130)] * 5 + [("a", "mnopq" * 75)] * 6 + [("b", "sz" * 180)] * 3
    segs = [(1, i, s, 0, 60 * len(t), t) for i, (s, t) in enumerate(said)]
    heard = {s: np.concatenate([np.sin(np.arange(60) * (0.2 + ord(ch) % 32 / 13)) for v, t in said if v == s for ch in t]).astype(np.float32).astype(float) for s in "ab"}
    cosine = lambda most: (lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b))(*[profiles.mfcc_vector(heard[s][:most], RATE) for s in "ab"])
    assert abs(cosine(None) - cosine(90_000)) > 0.01
    pairs = flow_queries._voices(voices.voice_pairs)(spark.createDataFrame(segs, SEGS)).collect()
    assert [(r.a, r.b, r.talk_a, r.talk_b) for r in pairs] == [("a", "b", len(heard["a"]), len(heard["b"]))]
    assert pairs[0].cosine == pytest.approx(cosine(None), abs=1e-4)
