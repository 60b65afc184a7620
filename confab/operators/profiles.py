"""Speaker profiles: audio of each speaker, extractors over it, labels and merging of fragments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.vectors import cosine
from confab.operators.segments import LABEL, REC

#: Non-speech marks and the badge shown for them: fixed values.
SOUND_BADGES = {
    "mhm": "👍 mhm", "hmm": "🤔 hmm", "hm": "🤔 hm", "aha": "💡 aha", "ugh": "😩 ugh", "uhh": "🔇 uhh", "uh": "🔇 uh", "eh": "🤷 eh",
    "[cough]": "🤧 kaszel", "[laugh]": "😄 śmiech", "[noise]": "🔊 szum", "[music]": "🎵 muzyka", "[applause]": "👏 aplauz",
}


def argmax(probs: Column) -> Column:
    """Key of the largest value of a map, first key in order on a tie."""
    entries = F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def sound_badge(text: Column) -> Column:
    bare = F.trim(F.translate(F.lower(text), ".,!?", ""))
    return F.create_map(*[F.lit(x) for kv in SOUND_BADGES.items() for x in kv])[bare]


def energy(pcm: Column, start: Column, end: Column, rate: int = 16_000) -> Column:
    """RMS of the samples from floor(start) to ceil(end), in seconds; 0 of none."""
    a, b = F.floor(start * rate).cast("int"), F.ceil(end * rate).cast("int")
    own = F.slice(pcm, a + 1, F.greatest(b - a, F.lit(0)))
    return F.when(F.size(own) > 0, F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(own))).otherwise(0.0)


def profiles(base: DataFrame, names: DataFrame, features: DataFrame) -> DataFrame:
    """Each profile (recording_id, speaker, ...) with its display name and audio features, where there are any."""
    return base.join(names, [REC, "speaker"], "left").join(features, [REC, "speaker"], "left")


def speaker_audio(segs: DataFrame, frames: DataFrame, frame_ms: int, least_ms: int = 500, most_ms: int = 90_000) -> DataFrame:
    """(recording_id, speaker, pcm): frames of a speaker's segments of ``least_ms`` or more, up to ``most_ms``.

    ``frames`` has recording_id, frame_idx and samples. The cut comes before the frames are gathered.
    """
    own = segs.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).select(REC, "speaker", F.explode(F.sequence(F.expr(f"start_ms div {frame_ms}"), F.expr(f"(end_ms - 1) div {frame_ms}"))).alias("frame_idx")).distinct()
    nth = F.row_number().over(Window.partitionBy(REC, "speaker").orderBy("frame_idx"))
    own = own.withColumn("_n", nth).filter(F.col("_n") * frame_ms <= most_ms).join(frames, [REC, "frame_idx"])
    return own.groupBy(REC, "speaker").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "samples"))), lambda s: s["samples"])).alias("pcm"))


def onset_rate(x: np.ndarray, rate: int = 16_000, hop: int = 512) -> float | None:
    """Peaks a second of the rise in frame energy, 0.8 times the mean or more and four frames apart."""
    if len(x) < 0.2 * rate:
        return None
    n = len(x) // hop
    level = np.log1p(np.sqrt((x[: n * hop].reshape(n, hop) ** 2).mean(axis=1)) * 100)
    rise = np.maximum(0, np.diff(level))
    last, peaks = -4, 0
    for i in range(1, len(rise) - 1):
        if rise[i] >= max(rise[i - 1], rise[i + 1], 0.8 * rise.mean(), 1e-9) and i - last >= 4:
            last, peaks = i, peaks + 1
    return peaks / (len(x) / rate)


#: Samples of a frame, and from one frame to the next.
SIZE, HOP = 512, 256


def cepstra(x: np.ndarray, rate: int = 16_000, coefficients: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mel cepstra of each frame and their first and second differences; audio below a frame is filled with silence."""
    bands = coefficients
    x = np.pad(x, (0, max(0, SIZE - len(x))))
    n = 1 + (len(x) - SIZE) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[::HOP][:n] * np.hanning(SIZE)
    power = np.abs(np.fft.rfft(frames)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(SIZE, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    logs = np.log(power @ np.maximum(0, np.minimum(up, down)).T + 1e-10)
    k = np.arange(bands)
    cep = logs @ np.cos(np.pi / bands * (k[:, None] + 0.5) * k[None])
    delta = np.gradient(cep, axis=0) if n > 1 else np.zeros_like(cep)
    twice = np.gradient(delta, axis=0) if n > 1 else np.zeros_like(cep)
    return cep, delta, twice


def mfcc_vector(x: np.ndarray, rate: int = 16_000, coefficients: int = 40) -> np.ndarray:
    """Means and deviations of mel cepstra and their first and second differences: 6 x coefficients numbers."""
    return np.concatenate([s for c in cepstra(x, rate, coefficients) for s in (c.mean(axis=0), c.std(axis=0))])


EXTRACTORS: dict[str, Callable[[np.ndarray], float | None]] = {"speech_rate": onset_rate}


def extracted(audio: DataFrame, extractors: dict[str, Callable[[np.ndarray], float | None]] | None = None, most: int = 480_000) -> DataFrame:
    """(recording_id, speaker, features): every extractor over a speaker's first ``most`` samples; absent results are left out."""
    own = extractors or EXTRACTORS

    def run(batches):
        for pdf in batches:
            found = []
            for pcm in pdf["pcm"]:
                x = np.asarray(pcm, float)[:most]
                found.append({k: v for k, f in own.items() if (v := f(x)) is not None})
            yield pd.DataFrame({REC: pdf[REC], "speaker": pdf["speaker"], "features": found})

    return audio.select(REC, "speaker", "pcm").mapInPandas(run, f"{REC} long, speaker string, features map<string,double>")


def rate_label(rate: Column) -> Column:
    return F.when(rate < 2.5, "wolne").when(rate < 4.5, "normalne").when(rate.isNotNull(), "szybkie")


def remapped_fragment(fragment: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """(recording_id, raw, label): a fragment's speakers by most similar known one, else the next free numbers.

    ``fragment`` has recording_id, raw, vector and, with it, first, by which new numbers are given: the
    place where a speaker is first heard (else by name); ``known`` recording_id, label and vector. Of equally
    similar ones the first label holds. Both are the few speakers of a recording, which bounds the pairs.
    """
    pairs = fragment.select(REC, "raw", F.col("vector").alias("x")).join(known.select(REC, "label", F.col("vector").alias("y")), REC)
    best = pairs.groupBy(REC, "raw").agg(F.min(F.struct((-F.round(cosine(F.col("x"), F.col("y")), 6)).alias("s"), F.col("label"))).alias("b"))
    rows = fragment.select(REC, "raw", (F.col("first") if "first" in fragment.columns else F.col("raw")).alias("_first")).join(best, [REC, "raw"], "left").withColumn("found", F.when(F.col("b.s") <= -least, F.col("b.label")))
    used = known.groupBy(REC).agg(F.max(F.regexp_extract("label", r"(\d+)$", 1).try_cast("int")).alias("top"))
    nth = F.row_number().over(Window.partitionBy(REC, F.col("found").isNull()).orderBy("_first", "raw"))
    rows = rows.join(used, REC, "left").withColumn("label", F.coalesce("found", F.format_string(LABEL, F.coalesce("top", F.lit(0)) + nth)))
    return rows.select(REC, "raw", "label")
