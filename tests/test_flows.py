import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.operators import flows, profiles

SEG = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long, text string"


def test_speaker_audio_and_extractors(spark):
    segs = spark.createDataFrame([(1, 0, "A", 0, 1000, "x"), (1, 1, "B", 1000, 1300, "short"), (1, 2, "A", 2000, 3000, "y")], SEG)
    frames = spark.createDataFrame([(1, i, [float(i)] * 4) for i in range(30)], "recording_id long, frame_idx int, samples array<double>")
    audio = profiles.speaker_audio(segs, frames, 100, most_ms=1500)
    rows = audio.collect()
    assert [r.speaker for r in rows] == ["A"] and rows[0].pcm[::4] == [float(i) for i in [*range(10), *range(20, 25)]]
    got = profiles.extracted(audio, {"mean": lambda x: float(x.mean()), "none": lambda x: None}).first()
    assert got.features == {"mean": pytest.approx(np.mean(rows[0].pcm))}


def test_signal_kernels():
    rate = 16_000
    x = np.zeros(rate * 4)
    for k in range(12):  # three bursts a second
        at = int((k + 0.5) * rate / 3)
        x[at : at + 1600] = np.sin(np.arange(1600) * 0.3)
    assert profiles.onset_rate(x) == pytest.approx(3.0, abs=0.3)
    assert profiles.onset_rate(x[:1000]) is None
    v = profiles.mfcc_vector(x)
    assert v.shape == (240,) and np.isfinite(v).all() and np.isfinite(profiles.mfcc_vector(np.zeros(10))).all()


def test_labels(spark):
    r = spark.range(1).select(
        profiles.sound_badge(F.lit("[Laugh].")).alias("a"), profiles.sound_badge(F.lit("tak")).alias("b"), profiles.rate_label(F.lit(3.0)).alias("c"),
        profiles.energy(F.array(F.lit(3.0), F.lit(4.0)), F.lit(0.0), F.lit(1.0), rate=2).alias("d"), profiles.energy(F.array(F.lit(3.0)), F.lit(5.0), F.lit(5.0)).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.e) == ("😄 śmiech", None, "normalne", 0.0) and r.d == pytest.approx(12.5**0.5)


def test_refined_asks_only_about_short_rows(spark):
    rows = [(1, i, "AAB"[i % 3], i * 3000, i * 3000 + 2500, "x") for i in range(9)] + [(1, 9, "B", 27_000, 27_300, "short")]
    segs = spark.createDataFrame(rows, SEG)
    asked = []

    def ask(found):
        asked.extend(r.seg_id for r in found.collect())
        return found.select("recording_id", "seg_id", F.lit("nobody").alias("speaker"))

    got = flows.refined(segs, ask).collect()
    assert asked == [9] and len(got) == 10 and {r.speaker for r in got} <= {"A", "B"}


def test_summaries_of_short_and_long_texts(spark):
    segs = spark.createDataFrame([(1, 0, "A", 0, 10, "short text"), (2, 0, "A", 0, 9_000_000, "long " * 100)], SEG)
    calls = []

    def model(prompts):
        calls.append(sorted((r.recording_id, r.part) for r in prompts.collect()))
        return prompts.select("recording_id", "part", F.concat(F.lit("a\nb\nc\nd"), F.substring("prompt", 1, 0)).alias("reply"))

    got = {r.recording_id: r.summary for r in flows.summarised(segs, model, width=200).collect()}
    assert got == {1: "a b c", 2: "a b c"} and {x[0] for x in calls[0]} == {2} and len(calls[0]) == 3 and calls[1] == [(1, -1), (2, -1)]


def test_verdicts(spark):
    scores = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 2, 4), (2, 0, 1)], "recording_id long, seg_id int, score int")
    assert sorted(tuple(r) for r in flows.quality_verdict(scores).collect()) == [(1, 3.0, 0, False, True), (2, 1.0, 0, True, True)]


def test_recogniser_boundary_and_settings(spark):
    from confab.operators import asr

    s = asr.Transcription().updated(beam_size=3, unknown=1, language=None)
    assert s.beam_size == 3 and s.language is None
    chunks = spark.createDataFrame([(1, 0, 0, [0.0] * 3), (1, 1, 1000, [0.0])], "recording_id long, chunk int, start_ms long, samples array<double>")
    got = asr.transcribed(chunks, lambda x, c: [(i * 10, i * 10 + 5, f"t{i} {c['beam_size']}") for i in range(len(x))], s).collect()
    assert sorted((r.chunk, r.pos, r.start_ms, r.text) for r in got) == [(0, 0, 0, "t0 3"), (0, 1, 10, "t1 3"), (0, 2, 20, "t2 3"), (1, 0, 1000, "t0 3")]


def test_pitch_of_a_tone():
    from confab.operators.asr import mean_pitch

    t = np.arange(16_000) / 16_000
    assert mean_pitch(np.sin(2 * np.pi * 200 * t)) == pytest.approx(200, rel=0.02)
    assert mean_pitch(np.zeros(16_000)) is None


def test_assembled_messages_and_merges(spark):
    from confab.operators import asr

    segs = spark.createDataFrame([(1, 0, "A", 0, 10, "x"), (1, 1, "B", 10, 15, "y"), (1, 2, "C", 15, 50, "z")], SEG)
    profiles_ = spark.createDataFrame([(1, "A", 30), (2, "Z", 40)], "recording_id long, speaker string, age int")
    entities = spark.createDataFrame([(1, "person", ["Ada"])], "recording_id long, kind string, values array<string>")
    got = {r.recording_id: r for r in asr.assembled(segs, profiles_, entities).collect()}
    assert len(got[1].segments) == 3 and got[1].entities == {"person": ["Ada"]} and got[2].error == "no segments" and got[1].error is None
    chat = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q")], "recording_id long, pos int, role string, content string")
    new = asr.last_overwritten(chat, spark.createDataFrame([(1, "b"), (2, "b")], "recording_id long, content string"))
    assert sorted((r.recording_id, r.pos, r.content) for r in new.collect()) == [(1, 0, "q"), (1, 1, "b"), (2, 0, "q")]
    kind = "recording_id long, a string, b string, cosine double, conflict boolean, overlap boolean, talk_a long, talk_b long"
    pairs = spark.createDataFrame([(1, "A", "B", 0.995, False, False, 10, 5), (1, "A", "C", 0.3, False, False, 10, 35)], kind)
    assert {r.seg_id: r.speaker for r in asr.merged_speakers(segs, pairs).collect()} == {0: "GŁOS_02", 1: "GŁOS_02", 2: "GŁOS_01"}
    assert asr.prompted(segs, "summary").first().prompt.endswith("\nx")
