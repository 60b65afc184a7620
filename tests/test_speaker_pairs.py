"""Voices of every recording meet, over the whole table."""

import numpy as np
import pytest

from confab.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_voice_meets_those_of_its_recording(spark):
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    unit = [(i, v / np.linalg.norm(v)) for i, v in rows]
    pairs = {(i // 20, i, j): round(float(x @ y), 4) for i, x in unit for j, y in unit if i < j and i // 20 == j // 20}
    want = {key: s for key, s in pairs.items() if s >= 0.2}
    got = {(r.recording_id, r.a, r.b): r.cosine for r in catalog.QUERIES["speaker_similarity"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-9) and max(b for _, _, b in got) >= 100
