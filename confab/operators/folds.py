"""Order-dependent folds: each row's result depends on rows already changed, so a recording is one sequence.

Recordings are spread over the cluster; one recording's rows are folded by a Python loop over Arrow
batches. A recording is bounded by its length in time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from confab.operators.segments import REC, shown_text

_SENTENCE_END = (".", "!", "?", "…", ";")


def per_recording(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str, order: str = "seg_id") -> DataFrame:
    """Applies ``fold`` to each recording's rows (dicts in order); recording_id is added to its output."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold(pdf.sort_values(order).to_dict("records"))
        return pd.DataFrame([{REC: pdf[REC].iloc[0]} | r for r in out], columns=[REC, *names])

    return rows.groupBy(REC).applyInPandas(run, f"{REC} long, {schema}")


def sentence_fragments(segs: DataFrame, gap_ms: int = 100, most_ms: int = 15_000, same_speaker: bool = True) -> DataFrame:
    """(recording_id, first_id, speaker, start_ms, end_ms, text): fragments joined until a sentence ends or ``most_ms``."""

    def fold(rows):
        out = []
        for r in rows:
            last = out[-1] if out else None
            if last and (not same_speaker or r["speaker"] == last["speaker"]) and r["start_ms"] - last["end_ms"] <= gap_ms and r["end_ms"] - last["start_ms"] <= most_ms and not last["text"].rstrip().endswith(_SENTENCE_END):
                last["end_ms"], last["text"] = r["end_ms"], f"{last['text'].rstrip()} {r['text'].lstrip()}"
            else:
                out.append({"first_id": r["seg_id"], "speaker": r["speaker"], "start_ms": r["start_ms"], "end_ms": r["end_ms"], "text": r["text"]})
        return out

    return per_recording(segs.select(REC, "seg_id", "speaker", "start_ms", "end_ms", "text"), fold, "first_id int, speaker string, start_ms long, end_ms long, text string")


def _pairs(text: str) -> set:
    w = text.lower().split()
    return set(zip(w, w[1:], strict=False))


def _repeats(a: str, b: str, least: float = 0.85) -> bool:
    x, y = _pairs(a), _pairs(b)
    if not x or not y:
        return a.strip().lower() == b.strip().lower()
    return len(x & y) >= least * len(x | y)


def _run(text: str, least: int = 5) -> bool:
    w = "".join(c for c in text.lower() if c.isalnum() or c == "_" or c.isspace()).split()
    top = Counter(w).most_common(1)[0][1] if w else 0
    return len(w) >= least and top >= least and top > 0.7 * len(w)


def without_repetitions(segs: DataFrame, cutoff_ms: int = 0) -> DataFrame:
    """(recording_id, seg_id) kept: blank, early and one-word-run rows go unseen; repetitions go, but are compared next."""

    def fold(rows):
        out, prev = [], None
        for r in rows:
            if not r["text"].strip() or r["start_ms"] < cutoff_ms:
                continue
            if prev is not None and _repeats(r["text"], prev):
                prev = r["text"]
                continue
            if not _run(r["text"]):
                out.append({"seg_id": r["seg_id"]})
                prev = r["text"]
        return out

    return per_recording(segs.select(REC, "seg_id", "start_ms", "text"), fold, "seg_id int")


def without_near_duplicates(segs: DataFrame, above: float = 0.85) -> DataFrame:
    """(recording_id, seg_id) kept: a row like the last kept one of the same speaker (word Jaccard) goes."""

    def fold(rows):
        out, last = [], None
        for r in rows:
            own = set(r["text"].lower().split())
            if last and last[0] == r["speaker"] and (len(own & last[1]) / len(own | last[1]) if own | last[1] else 1.0) > above:
                continue
            out.append({"seg_id": r["seg_id"]})
            last = r["speaker"], own
        return out

    return per_recording(segs.select(REC, "seg_id", "speaker", "text"), fold, "seg_id int")


def buffered_chunks(segs: DataFrame, least: int = 800, tail: int = 150, tail_ids: int = 3, most: int = 300) -> DataFrame:
    """(recording_id, chunk_id, text, segment_ids, start_ms, end_ms, speaker): a buffer closes at ``least`` characters
    and the next one begins with its last ``tail`` characters and ids; the speaker stays from before. Blank rows are not seen."""

    def fold(rows):
        out, buf, ids, start, end, speaker = [], "", [], None, None, None

        def emit():
            out.append({"chunk_id": len(out), "text": buf.strip(), "segment_ids": list(ids), "start_ms": start, "end_ms": end, "speaker": speaker})

        for r in rows:
            if not r["text"]:
                continue
            if not buf:
                start, speaker = r["start_ms"], r["speaker"]
            buf = f"{buf} {r['text']}" if buf else r["text"]
            ids, end = [*ids, r["seg_id"]], r["end_ms"]
            if len(buf) >= least:
                emit()
                buf, ids, start = buf[-tail:], ids[-tail_ids:], end
            if len(out) >= most:
                return out
        if buf.strip():
            emit()
        return out

    return per_recording(segs.select(REC, "seg_id", "speaker", "start_ms", "end_ms", shown_text(segs).alias("text")), fold, "chunk_id int, text string, segment_ids array<int>, start_ms long, end_ms long, speaker string")
