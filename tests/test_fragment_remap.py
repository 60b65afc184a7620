"""Every row is a fragment's voice or a known one."""

import numpy as np

from confab.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_fragment_voice_is_named(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit, want = {i: v / np.linalg.norm(v) for i, v in rows.items()}, {}
    for rec in {i // 20 for i in unit}:
        known = [i for i in unit if i // 20 == rec and i % 20 < 8]
        new = max((i % 20 + 1 for i in known), default=0)
        for raw in (f"raw{i}" for i in sorted(unit, reverse=True) if i // 20 == rec and i % 20 >= 8):  # the last row is heard first
            score, label = max(((round(float(unit[int(raw[3:])] @ unit[k]), 6), f"GŁOS_{k % 20 + 1:02d}") for k in known), default=(-1, ""))
            if score < 0.3:
                new += 1
                label = f"GŁOS_{new:02d}"
            want[rec, raw] = label
    got = {(r.recording_id, r.raw): r.label for r in catalog.QUERIES["fragment_remap"](spark, SF).collect()}
    assert got == want and len(got) == sum(i % 20 >= 8 for i in rows)
