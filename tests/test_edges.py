"""Hand-made cases that the tables never trigger."""

import io
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions import text as t
from confab.functions import vectors as v
from confab.operators import models as m
from confab.operators import flows, profiles, retrieval, signal
from confab.operators import segments as s
from confab.operators import text as x
from confab.sources import transcripts as tr
from confab.streaming import sessions as st

SEG = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long, text string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    r = one(spark, t.folded(F.lit("Zażółć  GĘŚLĄ, jaźń!")), t.phonetic_key(F.lit("rzeszoto")), t.is_word_run(F.lit("no no, no no no")), t.is_word_run(F.lit("no no no no tak inny")), t.is_repetition(F.lit("a b c"), F.lit("A b C")), t.is_repetition(F.lit("tak"), F.lit(" TAK ")), t.is_repetition(F.lit("a b c"), F.lit("a c b")), t.clock(F.lit(3_725_000)))
    assert tuple(r) == ("zazolc gesla jazn", "zst", True, False, True, True, False, "62:05")
    stamps = {"01:02:03.5": 3723.5, "02:03.5": 123.5, "3.5": 3.5, "N/A": 0.0, "": 0.0, "x:y": 0.0, "1:2:3:4": 0.0, None: 0.0}
    df = spark.createDataFrame([(k,) for k in stamps], "s string").select("s", t.seconds_of(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == stamps
    r = one(spark, t.first_json(F.lit('x {"a": {"b": 1}} y')), t.first_json(F.lit('x {"a": {"b": 1}} y'), greedy=False), t.first_json(F.lit("none")))
    assert tuple(r) == ('{"a": {"b": 1}}', '{"b": 1}', None)


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, y)) for y in ((3.0, 4.0), (4.0, 3.0), (0.0, 0.0)))
    r = one(spark, v.cosine(a, b), v.cosine(a, z), v.normalised(z), v.normalised(a))
    assert r[0] == pytest.approx(0.96) and r[1] == 0 and r[2] == [0, 0] and r[3] == [0.6, 0.8]


def test_tags_and_quality(spark):
    rows = [(1, 0, "A", 0, 25_000, "Dużo słów"), (1, 1, "B", 25_000, 25_300, "Mhm!"), (1, 2, "A", 30_000, 31_000, "Naprawdę? "), (1, 3, "A", 45_000, 46_000, "naprawdę?")]
    segs = spark.createDataFrame(rows, SEG)
    words = spark.createDataFrame([(1, 0, 0, "Dużo", 50), (1, 0, 1, "słów", 40)], "recording_id long, seg_id int, word_idx int, word string, prob_pct int")
    got = {r.seg_id: r.tags for r in s.tags(segs, words).collect()}
    assert got == {0: ["low-conf", "long"], 1: ["interjection", "check-speaker"], 2: ["question", "silence-gap"], 3: ["question", "silence-gap"]}
    q = s.quality_report(segs, words).first()
    assert (q.low_confidence, q.very_short, q.repetitions, q.long_gaps, q.avg_confidence, q.retranscribe) == (1, 1, 1, 1, 0.45, True)


def test_islands_end_where_their_last_row_ends(spark):
    rows = [(1, 0, "A", 0, 5000, "a"), (1, 1, "A", 100, 300, "b"), (1, 2, "B", 310, 400, "c")]
    got = s.merge_islands(spark.createDataFrame(rows, SEG)).orderBy("island").collect()
    assert [(r.speaker, r.start_ms, r.end_ms, r.text) for r in got] == [("A", 0, 300, "a b"), ("B", 310, 400, "c")]


def test_imports(spark):
    docs = [("a", '[{"text": "x"}, {"id": 7, "start": 1.5, "words": [{"text": " y", "alternatives": ["", "z"]}]}]'), ("b", '{"segments": [{"text": "q", "speaker": "S"}], "detected_language": "pl"}'), ("c", '{"other": 1}'), ("d", "junk")]
    df = spark.createDataFrame(docs, "recording_id string, json string")
    got = {(r.recording_id, r.seg_id): r for r in tr.imported(df).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)}
    assert got["a", 0].speaker == tr.DEFAULT_SPEAKER and got["a", 1].start_ms == 1500 and got["b", 0].language == "pl"
    assert got["a", 1].words[0].probability == 1.0 and got["a", 1].words[0].alternatives == ["z"]
    assert {r.seg_id for r in tr.imported(df, renumber=False).filter("recording_id = 'a'").collect()} == {0, 7}
    assert {r.recording_id for r in tr.rejected(df).collect()} == {"c", "d"}


def test_event_lines_chat_and_memories(spark):
    lines = spark.createDataFrame([('data: {"type": "result"}',), ("data: {broken",), (": ping",), ('data: {"type": "error"}',)], "value string")
    assert {r.type for r in tr.event_lines(lines).collect()} == {"result", "error"}
    chat = spark.createDataFrame([(1, 1, '{"message": {"content": "lo"}}'), (1, 0, '{"message": {"content": "hel"}}'), (1, 2, "junk")], "stream int, pos int, value string")
    assert tr.chat_text(chat).first().content == "hello"
    kind = "id int, created long, observation string, importance string"
    old = spark.createDataFrame([(1, 10, " Likes tea", "high"), (2, 20, "B", "low")], kind)
    got = tr.saved_memories(old, spark.createDataFrame([(3, 30, "likes TEA ", "low"), (4, 40, "C", "low")], kind), most=2).collect()
    assert [r.id for r in got] == [4, 2]
    assert tr.memory_prompt(old).first().prompt == "- [low] B\n- [high]  Likes tea"


def test_numbered_speakers(spark):
    rows = spark.createDataFrame([(1, 0, "x", " "), (1, 1, "y", "a"), (1, 2, "x", "b")], "recording_id long, seg_id int, speaker string, text string")
    assert {r.seg_id: r.label for r in tr.numbered_speakers(rows).collect()} == {1: "GŁOS_02", 2: "GŁOS_01"}


def test_audio(spark):
    tone = (np.sin(np.arange(8000) / 8000 * 2 * np.pi * 200) * 30000).astype("<i2")
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.column_stack([tone, tone]).tobytes())
    files = spark.createDataFrame([("a.wav", bytearray(raw.getvalue())), ("b.mp3", bytearray(b"ID3"))], "path string, content binary")
    got = {r.path: r for r in tr.decoded_audio(files, decode=lambda b: (np.zeros(16_000), 16_000)).collect()}
    assert got["a.wav"].seconds == 1.0 and len(got["a.wav"].pcm) == 16_000 and max(got["a.wav"].pcm) == pytest.approx(0.9155, abs=1e-3)
    pcm = spark.createDataFrame([(1, [0.0] * 8000), (2, [1.0, -1.0] * 4000), (3, [])], "recording_id long, pcm array<double>")
    q = {r.recording_id: r for r in signal.audio_quality(pcm).collect()}
    assert "quiet" in q[1].warnings and q[2].clip_ratio == 1.0 and "clipping" in q[2].warnings and q[3].noise_floor_db == -60


def test_signal_regions(spark):
    levels = [(1, i, 0.0 if 10 <= i < 40 else 0.2) for i in range(60)]
    df = spark.createDataFrame(levels, "recording_id long, frame_idx int, rms double")
    assert [tuple(r) for r in signal.silence_regions(df).collect()] == [(1, 1000, 4000)]
    assert signal.snr(df).first().snr_db == 40.0
    r = one(spark, signal.pitch_profile(F.lit(300.0)).alias("c"), signal.pitch_profile(F.lit(200.0)).alias("f"), signal.pitch_profile(F.lit(None).cast("double")).alias("n"))
    assert (r.c.gender, r.c.age, r.f.gender, r.f.age, r.n.age_group) == ("dziecko", 17.0, "zenski", 80.0, "nieznany")


def test_translation_boundary(spark):
    rows = spark.createDataFrame([(1, i, "A" if i else " ", i, i + 1, f"t{i}") for i in range(16)], SEG)
    seen = x.numbered_blocks(rows, x.translation_batches(rows)).orderBy("batch_id").collect()
    assert [r.n for r in seen] == [15, 1] and seen[0].block.startswith("1. t0\n2. [A] t1")
    reply = lambda blocks: blocks.select("recording_id", "batch_id", F.lit('{"tlumaczenia_pl": ["PL0", " "]}').alias("reply"))
    got = {r.seg_id: r.text_pl for r in x.translate(rows, reply).collect()}
    assert got[0] == "PL0" and got[1] == "t1" and got[15] == "PL0" and got[14] == "t14"

    def never(blocks):
        raise AssertionError

    assert x.translate(rows, never, "pl").filter("text_pl = text").count() == 16


def test_model_boundaries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, p string")
    assert {r.id: r.reply for r in m.called(df, "p", lambda ps: [q.upper() for q in ps]).collect()} == {1: "A", 2: "B", 3: "A"}
    texts = spark.createDataFrame([("a",), ("b",)], "text string")

    def broken(_):
        raise RuntimeError

    assert {tuple(r.embedding) for r in m.embedded(texts, broken, 2).collect()} == {(0.0, 0.0)}
    assert {tuple(r.embedding) for r in m.embedded(texts, lambda b: [[1, 2]] * len(b), 2).collect()} == {(1.0, 2.0)}
    rec = spark.createDataFrame([(1, 20.0), (2, 100.0), (3, 1000.0)], "recording_id long, duration double")
    got = {}
    for r in m.probe_positions(rec).collect():
        got.setdefault(r.recording_id, []).append(r.at)
    assert got == {1: [4.0], 2: [20.0, 65.0], 3: [150.0, 500.0, 800.0]}


def test_named_and_merged_speakers(spark):
    replies = spark.createDataFrame([(1, 'so {"A": "Ada", "B": "null", "C": " "}')], "recording_id long, reply string")
    assert [tuple(r) for r in m.named_speakers(replies).collect()] == [(1, "A", "Ada")]
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y")], "removed string, kept string")
    assert {r.removed: r.kept for r in retrieval.merge_map(pairs).collect()} == {"A": "D", "B": "D", "C": "D", "X": "Y"}
    pairs = spark.createDataFrame([("A", "B"), ("B", "A")], "removed string, kept string")
    assert {r.removed: r.kept for r in retrieval.merge_map(pairs).collect()} == {"A": "B", "B": "A"}
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "removed string, kept string")
    assert {r.kept for r in retrieval.merge_map(pairs).collect()} <= {"A", "B", "C"}
    kind = "recording_id long, a string, b string, cosine double, conflict boolean, overlap boolean, talk_a long, talk_b long"
    rows = [(1, "A", "B", 0.995, False, False, 5, 9), (1, "A", "C", 0.2, False, False, 5, 9), (2, "A", "B", 0.999, False, False, 1, 1), (3, "A", "B", 0.995, True, False, 1, 1), (3, "A", "C", 0.1, False, False, 1, 1)]
    assert [tuple(r) for r in m.guarded_merges(spark.createDataFrame(rows, kind)).collect()] == [(1, "A", "B")]


def test_edited_word(spark):
    df = spark.range(1).select(F.lit("x").alias("text"), F.array(*[F.struct(F.lit(w).alias("text"), F.array(F.lit("alt")).alias("alternatives")) for w in ("To", " jest", " to")]).alias("words"))
    r = st.edited_word(df, 1, "było").first()
    assert r.text == "To było to" and r.words[1].alternatives == [] and r.words[0].alternatives == ["alt"]


def test_hits_and_mmr(spark):
    chunks = spark.createDataFrame([(1, [5, 6]), (2, [5]), (3, [])], "vec_id long, segment_ids array<int>")
    hits = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.8)], "query_id long, vec_id long, score double")
    assert [tuple(r) for r in retrieval.hit_segments(hits, chunks).collect()] == [(0, 5, 0.9)]
    own = spark.createDataFrame([(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.001]), (0, 3, 0.5, [0.0, 1.0])], "query_id long, vec_id long, score double, embedding array<double>")
    assert [r.vec_id for r in retrieval.mmr(own, k=2).orderBy("rank").collect()] == [1, 3]


def test_keyword_scores_saturate_by_similarity(spark):
    docs = spark.createDataFrame([(1, "alpho beta")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, query string")
    got = {r.query_id: r.score for r in retrieval.keyword_scores(docs, asked).collect()}
    length = 1.5 * (0.25 + 0.75 * 2 / 60)
    assert got[2] == 1.0 and got[1] == pytest.approx(0.8 * 0.8 * 2.5 / (0.8 + length) / (2.5 / (1 + length)), abs=1e-6) and got[1] == pytest.approx(0.7456, abs=1e-4)


def test_words_of_three_letters_match_fuzzily_and_digraphs_twice(spark):
    docs = spark.createDataFrame([(1, "kod alpha")], "doc_id long, text string")
    got = retrieval.word_match(docs, spark.createDataFrame([(1, "kody")], "query_id long, query string")).first()
    assert (got.score, got.kind) == (0.75, "fuzzy")
    assert one(spark, t.phonetic_key(F.lit("oddział")))[0] == "zl"


def test_only_reactions_ask_to_check_their_speaker(spark):
    rows = [(1, 0, "A", 0, 1000, "one"), (1, 1, "B", 1000, 2000, "four words are here"), (1, 2, "A", 2000, 3000, "two"), (1, 3, "B", 3000, 4000, "Tak."), (1, 4, "A", 4000, 5000, "three")]
    words = spark.createDataFrame([(1, 2, 0, "two", 90, "tu"), (1, 4, 0, "three", 90, "")], "recording_id long, seg_id int, word_idx int, word string, prob_pct int, ipa string")
    segs = spark.createDataFrame(rows, SEG).withColumn("text_pl", F.when(F.col("seg_id") == 4, "Trzy?").otherwise(""))
    got = {r.seg_id: r.tags for r in s.tags(segs, words).collect()}
    assert got == {0: [], 1: [], 2: ["ipa"], 3: ["interjection", "check-speaker"], 4: ["question"]}


def test_mean_confidence_is_rounded_before_its_thresholds(spark):
    segs = spark.createDataFrame([(1, 0, "A", 0, 5000, "x")], SEG)
    words = spark.createDataFrame([(1, 0, i, "x", 60 if i else 59) for i in range(3000)], "recording_id long, seg_id int, word_idx int, word string, prob_pct int")
    got = s.quality_report(segs, words).first()
    assert got.avg_confidence == 0.6 and not got.retranscribe


def test_a_recording_without_turns_has_one_speaker(spark):
    segs = spark.createDataFrame([(1, i, "A", i * 1000, i * 1000 + 900, "x") for i in range(3)], SEG)
    turns = spark.createDataFrame([], "recording_id long, turn_idx int, speaker_raw string, start_ms long, end_ms long")
    assert {(r.seg_id, r.speaker) for r in flows.diarized(segs, turns).collect()} == {(i, "GŁOS_01") for i in range(3)}


def test_equally_similar_speakers_give_the_first(spark):
    heard = spark.createDataFrame([(1, "r", [1.0, 0.0])], "recording_id long, raw string, vector array<double>")
    known = spark.createDataFrame([(1, f"GŁOS_0{i}", [2.0, 0.0]) for i in (2, 1, 3)], "recording_id long, label string, vector array<double>")
    assert profiles.remapped_fragment(heard, known).first().label == "GŁOS_01"


def test_words_are_split_once(spark):
    """Splitting does not go into lambdas, which would do it for each word; results are those of plain loops."""
    texts = ["", "a", "no no no no no yes", "no no no no no no no maybe yes", "the same words here", "the same words here now", None, " ".join(f"w{i}" for i in range(3000)), "x, x! x x x y", "A b c D e f g h", "a B c d E f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("prev", F.expr("lag(text) over (order by i)"))
    run, again = t.is_word_run(F.col("text")).alias("run"), t.is_repetition(F.col("text"), F.col("prev")).alias("again")
    assert [str(c._jc).count("split(") if hasattr(c, "_jc") else 0 for c in (run, again)] == [1, 2]
    got = {r.i: (r.run, r.again) for r in df.select("i", run, again).collect()}

    def pairs(s):
        w = s.lower().strip().split()
        return set(zip(w, w[1:], strict=False))

    for i, s in enumerate(texts):
        if s is None:
            continue
        w = re.sub(r"[^\w\s]", "", s.lower()).split()
        top = max((w.count(x) for x in set(w)), default=0)
        assert got[i][0] == (len(w) >= 5 and top >= 5 and top * 10 > len(w) * 7)
        if i and texts[i - 1] is not None:
            x, y = pairs(s), pairs(texts[i - 1])
            assert got[i][1] == (len(x & y) >= 0.85 * len(x | y) if x and y else s.strip().lower() == texts[i - 1].strip().lower())
    assert got[2][0] and got[3][0] and not got[7][0] and got[10][1]
