"""Probes for speaker counts, context lines, translated counts and replies by digest."""

from confab.operators import asr, models, segments


def test_probes(spark):
    df = spark.createDataFrame([(1, 900.0), (2, 1000.0), (3, 0.0), (4, 3601.0)], "recording_id long, duration double")
    got = {}
    for r in asr.count_probes(df).collect():
        got.setdefault(r.recording_id, []).append((r.probe, r.start_ms, r.end_ms))
    assert got[1] == [(0, 0, 900_000)] and got[3] == [(0, 0, 0)]
    d = 1000.0
    want = [min(d * i / 8, d - 120) for i in range(8)]  # floor(1000 / 120) = 8
    assert sorted(got[2]) == [(i, round(a * 1000), round((a + 120) * 1000)) for i, a in enumerate(want)]
    assert len(got[4]) == 30 and max(e for _, _, e in got[4]) <= 3_601_000
    short = asr.count_probes(df.filter("recording_id = 2"), seconds=500).collect()
    assert {r.end_ms - r.start_ms for r in short} == {180_000}


def test_most_speakers_of_one_probe(spark):
    turns = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20), (1, "c", 130_000, 700_000), (1, "a", 650_000, 650_001), (1, "b", 660_000, 660_001), (1, None, 660_000, 660_001)], "recording_id long, speaker_raw string, start_ms long, end_ms long")
    probes = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 600_000, 720_000), (2, 0, 0, 5)], "recording_id long, probe int, start_ms long, end_ms long")
    got = {r.recording_id: (r.n_speakers, r.n_probes) for r in asr.probed_counts(turns.filter("speaker_raw is not null"), probes).collect()}
    assert got == {1: (3, 2), 2: (1, 1)}
    assert asr.probed_counts(turns.limit(0), probes.limit(0)).count() == 0


def test_context_lines(spark):
    rows = [(1, 3, "a", 61_999, " x ", None), (1, 5, "b", 3_600_000, "y", "pl"), (1, 9, None, None, None, ""), (2, 1, "a", 0, "", " ")]
    segs = spark.createDataFrame(rows, "recording_id long, seg_id int, speaker string, start_ms long, text string, text_pl string")
    names = spark.createDataFrame([(1, "a", "Ada")], "recording_id long, speaker string, name string")
    tags = spark.createDataFrame([(1, 3, ["q", "low"]), (1, 5, [])], "recording_id long, seg_id int, tags array<string>")
    got = {r.recording_id: (r.n_rows, r.transcript) for r in segments.context_lines(segs, names, tags).collect()}
    assert got == {1: (3, "[1:01 Ada] [q, low] x\n[60:00 b] [] pl\n[0:00 ?] "), 2: (1, "[0:00 a] ")}
    assert [r.transcript for r in segments.context_lines(segs, names, tags, 1, "a").filter("recording_id = 1").collect()] == ["[1:01 Ada] [q, low] x"]


def test_translated_counts(spark):
    rows = [(1, "a", "b"), (1, "a", "a"), (1, "a", ""), (1, "a", None), (1, None, "c"), (2, None, None)]
    df = spark.createDataFrame(rows, "recording_id long, text string, text_pl string")
    assert {r.recording_id: r.n_translated for r in segments.translated_counts(df).collect()} == {1: 2, 2: 0}


def test_null_prompts_are_not_asked(spark):
    def model(prompts):
        assert None not in prompts
        return [p * 2 for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, p string")
    assert sorted((r.id, r.reply) for r in models.called(df, "p", model).collect()) == [(1, "aa"), (2, None), (3, "aa")]
