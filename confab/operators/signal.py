"""Signal statistics on frames (recording_id, frame_idx, samples) and arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.segments import REC


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.greatest(F.size(samples), F.lit(1)))


def cut(pcm: DataFrame, frame: int, rate_col: str | None = None) -> DataFrame:
    """(recording_id, frame_idx, samples) of ``pcm`` (recording_id, pcm array): whole frames that start before n - frame."""
    at = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("pcm") - 1), F.lit(frame)), lambda i: i < F.size("pcm") - frame), lambda i: i))
    return pcm.select(REC, "pcm", at.alias("at")).select(REC, (F.col("at") / frame).cast("int").alias("frame_idx"), F.slice("pcm", F.col("at") + 1, frame).alias("samples"))


def audio_quality(pcm: DataFrame, frame: int = 400) -> DataFrame:
    """A row per recording: rms, peak, dynamic_db, clip_ratio, noise_floor_db, silence_ratio, warnings."""
    size = F.greatest(F.size("pcm"), F.lit(1))
    whole = pcm.select(REC, rms(F.col("pcm")).alias("rms"), F.coalesce(F.array_max(F.transform("pcm", F.abs)), F.lit(0.0)).alias("peak"), (F.size(F.filter("pcm", lambda x: F.abs(x) > 0.98)) / size).alias("clip_ratio"))
    energy = cut(pcm, frame).withColumn("e", F.pow(rms(F.col("samples")), 2))
    e = energy.groupBy(REC).agg(F.percentile("e", 0.1).alias("p10"), F.percentile("e", 0.2).alias("p20"))
    quiet = energy.join(e, REC).groupBy(REC).agg(F.avg((F.col("e") < F.col("p20")).cast("double")).alias("silence_ratio"))
    rows = whole.join(e, REC, "left").join(quiet, REC, "left")
    rows = rows.withColumns({"dynamic_db": 20 * F.log10(F.col("peak") / (F.col("rms") + 1e-10)), "noise_floor_db": F.coalesce(10 * F.log10(F.col("p10") + 1e-10), F.lit(-60.0)), "silence_ratio": F.coalesce("silence_ratio", F.lit(0.0))})
    warn = F.array(F.when(F.col("clip_ratio") > 0.001, "clipping"), F.when(F.col("rms") < 0.01, "quiet"), F.when(F.col("silence_ratio") > 0.65, "silence"), F.when(F.col("dynamic_db") < 6, "flat"))
    return rows.select(REC, "rms", "peak", "dynamic_db", "clip_ratio", "noise_floor_db", "silence_ratio", F.array_compact(warn).alias("warnings"))


def frame_levels(frames: DataFrame) -> DataFrame:
    return frames.select(REC, "frame_idx", rms(F.col("samples")).alias("rms"))


def silence_regions(levels: DataFrame, frame_ms: int = 100, below: float = 0.005, least_ms: int = 1500) -> DataFrame:
    """(recording_id, start_ms, end_ms): runs of quiet frames of ``least_ms`` or more."""
    w = Window.partitionBy(REC).orderBy("frame_idx")
    rows = levels.filter(F.col("rms") < below).withColumn("island", F.col("frame_idx") - F.row_number().over(w))
    g = rows.groupBy(REC, "island").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    return g.select(REC, (F.col("a") * frame_ms).alias("start_ms"), ((F.col("b") + 1) * frame_ms).alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def speech_bounds(levels: DataFrame, frame_ms: int = 50, least: float = 0.01, pad_ms: int = 500, min_silence_ms: int = 1000) -> DataFrame:
    """(recording_id, start_ms, end_ms): first to last loud frame with padding; all of a short or silent recording."""
    loud = F.when(F.col("rms") >= least, F.col("frame_idx"))
    g = levels.groupBy(REC).agg(F.min(loud).alias("a"), F.max(loud).alias("b"), ((F.max("frame_idx") + 1) * frame_ms).alias("n"))
    whole = F.col("a").isNull() | (F.col("n") < 2 * min_silence_ms)
    return g.select(REC, F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.col("a") * frame_ms - pad_ms)).alias("start_ms"), F.when(whole, F.col("n")).otherwise(F.least(F.col("n"), (F.col("b") + 1) * frame_ms + pad_ms)).alias("end_ms"))


def vad_threshold(levels: DataFrame, base: float = 0.25) -> DataFrame:
    """(recording_id, threshold) from the median and the largest frame level."""
    g = levels.groupBy(REC).agg(F.percentile("rms", 0.5).alias("m"), F.max("rms").alias("x"))
    t = F.when(F.col("m") < 0.005, F.greatest(F.lit(0.10), F.lit(base - 0.10))).when(F.col("m") < 0.02, F.greatest(F.lit(0.12), F.lit(base - 0.06))).when((F.col("x") > 0.3) & (F.col("x") > 8 * F.col("m")), F.least(F.lit(0.50), F.lit(base + 0.05))).otherwise(F.lit(base))
    return g.select(REC, t.alias("threshold"))


def overlapping_chunks(lengths: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(recording_id, chunk, start, end) of ``lengths`` (recording_id, n): the next begins ``overlap`` before an end."""
    starts = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)).cast("long"), F.lit(chunk - overlap).cast("long")), lambda s: (s == 0) | (s + overlap < F.col("n")))
    return lengths.select(REC, "n", F.posexplode(starts).alias("chunk", "start")).select(REC, "chunk", "start", F.least(F.col("start") + chunk, "n").alias("end"))


def waveform_peaks(pcm: DataFrame, columns: int = 1200) -> DataFrame:
    """(recording_id, peaks): largest absolute sample of each of ``columns`` equal blocks; the rest is left out."""
    n = F.least(F.lit(columns), F.size("pcm"))
    block = F.greatest(F.lit(1), F.floor(F.size("pcm") / F.greatest(n, F.lit(1)))).cast("int")
    peaks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_max(F.transform(F.slice("pcm", i * block + 1, block), F.abs)))
    return pcm.select(REC, F.when(F.size("pcm") > 0, peaks).otherwise(F.array().cast("array<double>")).alias("peaks"))


def snr(levels: DataFrame) -> DataFrame:
    """(recording_id, snr_db, label): level over that of the quietest tenth of frames, within 0 to 60 dB."""
    rank = F.row_number().over(Window.partitionBy(REC).orderBy("rms", "frame_idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy(REC))
    rows = levels.withColumns({"r": rank, "n": n})
    g = rows.groupBy(REC).agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("s"), F.avg(F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("rms"))).alias("q"))
    db = F.when(F.col("s") < 1e-9, F.lit(None)).when(F.col("q") < 1e-9, F.lit(40.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(60.0), 20 * F.log10(F.col("s") / F.col("q")))))
    return g.withColumn("snr_db", db).select(REC, "snr_db", F.when(F.col("snr_db").isNull(), "cisza").when(F.col("snr_db") < 10, "niski (szum)").when(F.col("snr_db") < 25, "sredni").otherwise("wysoki (czysty)").alias("label"))


def pitch_profile(f0: Column) -> Column:
    """struct(gender, age, age_group) from a mean voiced pitch in Hz."""
    gender = F.when(f0 > 250, "dziecko").when(f0 >= 165, "zenski").when(f0.isNotNull(), "meski")
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    age = F.when(f0 > 250, clamp(300 - 0.5 * f0, 5, 17)).when(f0 >= 165, clamp(300 - 0.8 * f0, 18, 80)).when(f0.isNotNull(), clamp(220 - 0.7 * f0, 18, 80))
    return F.struct(gender.alias("gender"), age.alias("age"), age_group(age, gender).alias("age_group"))


def calibrated_age(raw: Column) -> Column:
    return F.when(raw < 35, F.greatest(F.lit(5), raw - 8)).when(raw < 55, F.greatest(F.lit(18), raw - 10)).otherwise(F.greatest(F.lit(18), raw - 12))


def age_group(age: Column, gender: Column) -> Column:
    return F.when(age.isNull(), "nieznany").when((gender == "dziecko") | (age < 18), "dziecko").when(age < 30, "mlody").when(age < 55, "dorosly").otherwise("starszy")
