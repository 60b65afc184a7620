"""Around a speech recogniser: settings, chunk cut-offs, choice of runs, and the boundary itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.segments import REC, binned


@dataclass(frozen=True)
class Transcription:
    """Settings of a transcription; ``updated`` takes known ones that are not None."""

    language: str | None = None
    beam_size: int = 5
    temperature: float = 0.0
    vad_threshold: float = 0.25
    min_silence_ms: int = 500
    chunk_ms: int = 900_000
    overlap_ms: int = 20_000
    prompt_texts: int = 3
    prompt_chars: int = 120

    def updated(self, **values) -> Transcription:
        return Transcription(**asdict(self) | {k: v for k, v in values.items() if k in asdict(self) and v is not None})


_SEGMENTS = f"{REC} long, chunk int, pos int, start_ms long, end_ms long, text string"


def transcribed(chunks: DataFrame, recognise: Callable[[list[float], dict], list[tuple[int, int, str]]], settings: Transcription = Transcription()) -> DataFrame:  # noqa: B008
    """(recording_id, chunk, pos, start_ms, end_ms, text) of ``chunks`` (recording_id, chunk, start_ms, samples).

    ``recognise(samples, settings)`` gives (start, end, text) in milliseconds from the chunk's start.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r[REC], r["chunk"], i, r["start_ms"] + a, r["start_ms"] + b, text)
                for r in pdf.to_dict("records")
                for i, (a, b, text) in enumerate(recognise(list(r["samples"]), asdict(settings)))
            ]
            yield pd.DataFrame(rows, columns=[REC, "chunk", "pos", "start_ms", "end_ms", "text"])

    return chunks.select(REC, "chunk", "start_ms", "samples").mapInPandas(run, _SEGMENTS)


def without_overlap(rows: DataFrame, chunks: DataFrame, overlap_ms: int = 20_000) -> DataFrame:
    """Rows (recording_id, chunk, start_ms, ...) of later chunks that start in the first half of the overlap go."""
    starts = chunks.select(REC, "chunk", F.col("start_ms").alias("_at"))
    return rows.join(starts, [REC, "chunk"]).filter((F.col("chunk") == 0) | (F.col("start_ms") >= F.col("_at") + overlap_ms / 2)).drop("_at")


def speaker_counts(turns: DataFrame) -> DataFrame:
    """(recording_id, n_speakers): distinct speakers, one at least; of several probes the largest count."""
    by = [REC, "probe"] if "probe" in turns.columns else [REC]
    g = turns.groupBy(*by).agg(F.greatest(F.lit(1), F.count_distinct("speaker_raw")).alias("n_speakers"))
    return g.groupBy(REC).agg(F.max("n_speakers").alias("n_speakers"))


def count_probes(recordings: DataFrame, seconds: float = 120.0, whole: float = 900.0) -> DataFrame:
    """(recording_id, probe, start_ms, end_ms): where to count speakers in recordings (recording_id, duration in seconds).

    All of one up to ``whole`` seconds; of a longer one a probe for every two minutes, four at least, spread evenly and moved back
    from the end, of ``seconds`` but not beyond 180 each.
    """
    n, length = F.col("duration"), min(seconds, 180.0)
    many = F.greatest(F.lit(4), F.floor(n / 120).cast("int"))
    at = F.when(n <= whole, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.greatest(F.lit(0.0), F.least(n * i / many, n - length))))
    rows = recordings.select(REC, "duration", F.posexplode(at).alias("probe", "_at"))
    end = F.when(n <= whole, n).otherwise(F.least(F.col("_at") + length, n))
    return rows.select(REC, "probe", F.round(F.col("_at") * 1000).cast("long").alias("start_ms"), F.round(end * 1000).cast("long").alias("end_ms"))


def probed_counts(turns: DataFrame, probes: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """(recording_id, n_speakers, n_probes): the most speakers (recording_id, speaker_raw, start_ms, end_ms) that one probe hears, one at least.

    Turns and probes meet in time bins, so a long recording is many keys.
    """
    spans = binned(probes, bin_ms).select(REC, "probe", "_bin", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    met = binned(turns.select(REC, "speaker_raw", "start_ms", "end_ms"), bin_ms).join(spans, [REC, "_bin"]).filter("start_ms < _e and end_ms > _s")
    counts = met.select(REC, "probe", "speaker_raw").distinct().groupBy(REC, "probe").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(REC).agg(F.max("n").alias("n"))
    return probes.groupBy(REC).agg(F.count(F.lit(1)).alias("n_probes")).join(counts, REC, "left").select(REC, F.greatest(F.lit(1), F.coalesce("n", F.lit(1))).alias("n_speakers"), "n_probes")


def chosen_run(turns: DataFrame, least: float = 0.05) -> DataFrame:
    """Turns (recording_id, run, speaker_raw, start_ms, end_ms, ...) of run 1 where its quietest speaker has ``least`` of the time, else of run 0."""
    g = turns.filter("run = 1").groupBy(REC, "speaker_raw").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    more = g.groupBy(REC).agg((F.min("ms") >= least * F.sum("ms")).alias("_more"))
    return turns.join(more, REC, "left").filter(F.col("run") == F.when(F.col("_more"), 1).otherwise(0)).drop("_more")


def prompts(rows: DataFrame, texts: int = 3, chars: int = 120) -> DataFrame:
    """(recording_id, seg_id, prompt): what a recogniser hears before a row: the last texts, cut."""
    w = Window.partitionBy(REC).orderBy("seg_id").rowsBetween(-texts, -1)
    return rows.select(REC, "seg_id", F.array_join(F.transform(F.collect_list("text").over(w), lambda t: F.substring(t, 1, chars)), " ").alias("prompt"))


def mean_pitch(x: np.ndarray, rate: int = 16_000, low: float = 60.0, high: float = 400.0) -> float | None:
    """Mean pitch in Hz of voiced frames (autocorrelation peak of 0.5 or more); None without any."""
    size, found = int(rate * 0.04), []
    for at in range(0, len(x) - size + 1, size // 2):
        frame = x[at : at + size] - x[at : at + size].mean()
        power = float(frame @ frame)
        if power < 1e-6 * size:
            continue
        corr = np.fft.irfft(np.abs(np.fft.rfft(frame, 2 * size)) ** 2)[:size] / power
        corr = corr * size / np.maximum(1, size - np.arange(size))
        a, b = int(rate / high), min(int(rate / low), size * 3 // 4)
        near = corr[a:b]
        peaks = np.flatnonzero((near[1:-1] >= near[:-2]) & (near[1:-1] >= near[2:]) & (near[1:-1] >= max(0.5, 0.9 * near.max()))) + 1
        if len(peaks):  # the shortest good lag is the period, longer ones are its multiples
            found.append(rate / (a + int(peaks[0])))
    return float(np.mean(found)) if found else None


def assembled(segs: DataFrame, profiles: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per recording with its segments, profiles and entities as arrays; recordings without segments have an error."""
    s = segs.groupBy(REC).agg(F.array_sort(F.collect_list(F.struct("seg_id", "start_ms", "end_ms", "speaker", "text"))).alias("segments"))
    p = profiles.groupBy(REC).agg(F.array_sort(F.collect_list(F.struct("speaker", *[c for c in profiles.columns if c not in (REC, "speaker")]))).alias("profiles"))
    e = entities.groupBy(REC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("entities"))
    return s.join(p, REC, "full_outer").join(e, REC, "full_outer").withColumn("error", F.when(F.col("segments").isNull(), "no segments"))


#: Prompt forms of the model calls, with the characters of text that each takes.
PROMPTS = {"entities": ("List people, places, organisations, dates and keywords as JSON:\n%s", 4000), "summary": ("Summarise in Polish:\n%s", 6000), "reduce": ("Join these partial summaries:\n%s", 12_000), "rag": ("Answer from the context only:\n%s", 6000)}


def prompted(rows: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """Adds ``prompt``: the form of ``kind`` around the start of the text."""
    form, chars = PROMPTS[kind]
    return rows.withColumn("prompt", F.format_string(form, F.substring(text_col, 1, chars)))


def forgotten(memories: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Memories without those named, or none at all."""
    return memories.filter(~F.col("id").isin(ids)) if ids is not None else memories.limit(0)


def last_overwritten(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """Chat messages (recording_id, pos, role, content) with each recording's last assistant content replaced.

    ``updates`` has recording_id and content; without an assistant message nothing changes.
    """
    last = messages.filter("role = 'assistant'").groupBy(REC).agg(F.max("pos").alias("pos"))
    new = last.join(updates.select(REC, F.col("content").alias("_new")), REC)
    return messages.join(new, [REC, "pos"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def merged_speakers(segs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(recording_id, seg_id, speaker): duplicate speakers merged (``pairs`` as ``guarded_merges`` takes them), chains
    followed within a recording, labels anew by talk time."""
    from confab.operators.models import guarded_merges
    from confab.operators.retrieval import merge_map
    from confab.operators.segments import talk_time

    key = lambda c: F.concat_ws("\u0001", F.col(REC).cast("string"), c)
    found = guarded_merges(pairs).select(key(F.col("removed")).alias("removed"), key(F.col("kept")).alias("kept"))
    resolved = merge_map(found).select("removed", F.element_at(F.split("kept", "\u0001"), 2).alias("_kept"))
    rows = segs.withColumn("_key", key(F.col("speaker"))).join(resolved, F.col("_key") == F.col("removed"), "left").withColumn("speaker", F.coalesce("_kept", "speaker")).drop("_key", "removed", "_kept")
    labels = talk_time(rows).select(REC, "speaker", "label")
    return rows.join(labels, [REC, "speaker"]).select(REC, "seg_id", F.col("label").alias("speaker"))
