"""Registered queries keep what the operators' own caps keep."""

import pytest

from confab.operators import text as x
from confab.plans import catalog
from confab.plans.text_queries import _base

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.recording_id: r.text for r in x.transcripts(_base(spark, SF)[1]).collect()}


def test_char_windows_hold_the_whole_text(spark, texts):
    got = {}
    for r in sorted(catalog.QUERIES["char_windows"](spark, SF).collect(), key=lambda r: (r.recording_id, r.window)):
        got[r.recording_id] = got.get(r.recording_id, "") + (r.chunk[600:] if r.window else r.chunk)
    assert got == {i: t[:33_000] for i, t in texts.items()} and max(map(len, texts.values())) > 5500


def test_topic_windows_hold_every_segment(spark):
    rows = catalog.QUERIES["topic_windows"](spark, SF).collect()
    assert max(r.win_id for r in rows) < 8 and sum(r.n for r in rows) == _base(spark, SF)[1].count()


def test_index_entries_hold_every_chunk(spark):
    chunks = x.sliding_chunks(_base(spark, SF)[1]).filter("chunk_id < 300").select("recording_id", "chunk_id", "text")
    got = {tuple(r) for r in catalog.QUERIES["index_entries"](spark, SF).select("recording_id", "chunk_id", "text").collect()}
    assert got == {tuple(r) for r in chunks.collect()} and max(c for _, c, _ in got) >= 4


def test_short_recordings_are_summarised_in_one_call(spark, texts):
    got = {r.recording_id: r.summary for r in catalog.QUERIES["map_reduce_summary"](spark, SF).collect()}
    assert max(map(len, texts.values())) > 1000
    assert got == {i: " ".join(["S " + t[:40], "line", "more"]) for i, t in texts.items()}
