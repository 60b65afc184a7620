"""Cases in which an operator's outcome was once misread."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import flows, folds, models, profiles, segments
from confab.operators import text as x
from confab.sources import transcripts as tr
from confab.streaming import sessions as st

SEGS = "recording_id long, seg_id int, speaker string, start_ms long, end_ms long, text string"


def test_overlap_runs_to_the_end_of_the_turn_before(spark):
    turns = spark.createDataFrame([(1, 0, "b", 0, 10_000), (1, 1, "a", 2000, 3000), (1, 2, "b", 20_000, 21_000)], "recording_id long, turn_idx int, speaker_raw string, start_ms long, end_ms long")
    got = {r.turn_idx: (r.overlapping, r.overlap_with, r.overlap_sec) for r in segments.overlap_flags(turns).collect()}
    assert got == {0: (False, None, None), 1: (True, "GŁOS_01", 8.0), 2: (False, None, None)}


def test_passes_are_arbitrated(spark):
    kind = "key int, dur_ms int, a_text string, a_conf double, b_text string, b_conf double, c_text string, c_conf double"
    rows = [
        (1, 400, "tak jest", 0.40, "tak jest", 0.42, None, None),  # agree: kept
        (2, 400, "tak jest", 0.20, "nie ma", 0.29, None, None),  # disagree, both unsure: gone
        (3, 400, "tak jest", 0.20, "nie ma", 0.31, None, None),  # the surer one
        (4, 600, "tak jest", 0.20, "nie ma", 0.29, "no tak", 0.5),  # not below half a second, wider hearing is surer
        (5, 2900, "a b", 0.44, "c d", 0.9, "e f", 0.45),  # too long to arbitrate, short enough for the wider window
        (6, 3000, "a b", 0.1, "c d", 0.9, "e f", 0.45), (7, 100, " ", 0.9, "c", 0.99, "d", 0.99), (8, 400, "a", 0.1, None, None, "", 0.9),
    ]
    got = {r.key: (r.text, r.confidence, r.kept) for r in models.multi_pass(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("tak jest", 0.40, True), 2: ("nie ma", 0.29, False), 3: ("nie ma", 0.31, True), 4: ("no tak", 0.5, True), 5: ("e f", 0.45, True), 6: ("a b", 0.1, True), 7: (" ", 0.9, False), 8: ("a", 0.1, True)}
    two = models.multi_pass(spark.createDataFrame([r[:6] for r in rows], kind[: kind.index(", c_text")]))
    assert {r.key: r.text for r in two.collect()}[4] == "nie ma"


def test_buffer_keeps_its_blanks(spark):
    rows = [(1, 0, "A", 0, 5, "a" * 650 + " " + "b" * 149), (1, 1, "B", 5, 6, " "), (1, 2, "B", 6, 9, "c" * 649)]
    got = folds.buffered_chunks(spark.createDataFrame(rows, SEGS)).orderBy("chunk_id").collect()
    assert [r.segment_ids for r in got] == [[0], [0, 2], [0, 2]] and got[1].text.startswith("b")


def test_translations_are_shown_first(spark):
    df = spark.createDataFrame([(1, 0, "A", 0, 1, " one ", "jeden"), (1, 1, "A", 1, 2, "two", ""), (1, 2, "A", 2, 3, "", None), (1, 3, "A", 3, 4, "four", None)], SEGS + ", text_pl string")
    assert x.transcripts(df).first().text == "jeden two  four"
    assert folds.buffered_chunks(df).first().text == "jeden two four"
    scored = df.withColumn("score", F.when(F.col("seg_id") == 3, 2).otherwise(5))
    assert [tuple(r) for r in models.retry_contexts(scored).collect()] == [(1, 3, "two\nfour")]


def test_retries_count_if_new(spark):
    rows = spark.createDataFrame([(1, i, "Tak", "old") for i in range(4)], "recording_id long, seg_id int, text string, text_pl string")
    tries = spark.createDataFrame([(1, 0, " TAK "), (1, 1, "  "), (1, 2, " nowe ")], "recording_id long, seg_id int, retry string")
    assert {r.seg_id: r.text_pl for r in models.applied_retries(rows, tries).collect()} == {0: "old", 1: "old", 2: "nowe", 3: "old"}


def test_verdict_is_needed_below_three_and_advised_below_three_and_a_half(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 4), (2, 0, 2), (2, 1, 3)], "recording_id long, seg_id int, score int")
    assert {r.recording_id: (r.retranslate, r.recommended) for r in flows.quality_verdict(rows).collect()} == {1: (False, True), 2: (True, True)}


def test_edits_keep_white_space_and_the_translation_follows(spark):
    df = spark.range(1).select(F.col("id"), F.lit("x").alias("text"), F.array(*[F.struct(F.lit(w).alias("text"), F.array(F.lit("alt")).alias("alternatives")) for w in ("\tHi", "\u00a0 there")]).alias("words"))
    r = st.edited_word(df, 0, " Yo ").first()
    assert r.words[0].text == "\tYo" and r.text == r.text_pl == "Yo\u00a0 there"
    edits = df.select("id", F.lit("new").alias("text"), F.lit(2).alias("n")).union(df.select("id", F.lit("old"), F.lit(1)))
    r = st.edited_text(df, edits, ["id"], "n").first()
    assert r.text == r.text_pl == "new" and r.words[0].text == "\tHi"
    assert st.edited_text(df, edits.filter("n > 2"), ["id"], "n").first().text_pl is None


def test_new_voices_are_numbered_as_they_are_heard(spark):
    heard = spark.createDataFrame([(1, "a", [1.0, 0.0], 50), (1, "b", [0.0, 1.0], 20)], "recording_id long, raw string, vector array<double>, first long")
    known = spark.createDataFrame([(1, "GŁOS_03", [-1.0, -1.0])], "recording_id long, label string, vector array<double>")
    assert {r.raw: r.label for r in profiles.remapped_fragment(heard, known).collect()} == {"b": "GŁOS_04", "a": "GŁOS_05"}


@pytest.mark.parametrize("seed", range(3))
def test_random_cuts_give_the_lines_of_the_whole(spark, seed):
    r, rows, want = random.Random(seed), [], []
    for stream in range(6):
        lines = ["".join(r.choice("aż漢😀 \r") for _ in range(r.randrange(40))) for _ in range(r.randrange(60))]
        data = "\n".join(lines).encode()
        want += [(stream, i, s) for i, s in enumerate(lines[:-1])]
        pos = r.randrange(3) * 5000
        while data:
            n = r.choice([0, 1, 2, 3, 50, 400])
            rows.append((stream, pos, bytearray(data[:n]) if n or r.random() < 0.5 else None))
            data, pos = data[n:], pos + r.choice([1, 1, 3000])
    got = tr.stitched_lines(spark.createDataFrame(rows, "stream int, pos long, data binary").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(want)
