"""Speakers compared by their audio: cepstral moments of blocks that merge per speaker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.vectors import cosine
from confab.operators.asr import merged_speakers
from confab.operators.profiles import HOP, SIZE, cepstra
from confab.operators.segments import REC, speakers_overlap
from confab.sources.storage import settled

#: Frames on either side that second differences look at.
_REACH = 2


def speaker_streams(segs: DataFrame, rate: int, most_s: float | None = 90.0) -> DataFrame:
    """(recording_id, speaker, seg_id, start, n, at, total): each segment's samples within its speaker's audio, in order.

    ``at`` is the place of the segment's first sample there, ``total`` is all that counts of the speaker: the whole audio, or its first ``most_s`` seconds.
    """
    w = Window.partitionBy(REC, "speaker").orderBy("seg_id")
    start = F.expr(f"start_ms * {rate} div 1000")
    rows = segs.filter("speaker is not null and start_ms is not null and end_ms > start_ms")
    rows = rows.select(REC, "speaker", "seg_id", start.alias("start"), (F.expr(f"end_ms * {rate} div 1000") - start).alias("n")).filter("n > 0")
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if most_s is not None:
        rows = rows.filter(F.col("at") < int(most_s * rate)).withColumn("n", F.least("n", int(most_s * rate) - F.col("at")))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(REC, "speaker")))


def stream_pieces(streams: DataFrame, audio: DataFrame, block: int, made: bool = False) -> DataFrame:
    """(recording_id, speaker, at, samples): the samples of ``streams`` in ``audio`` (recording_id, start, samples), placed in the speaker's audio.

    Audio and segments meet in bins of ``block`` samples. Blocks of audio don't overlap; where audio is missing, there is no piece (and silence
    in the frames). A plan cannot tell how long arrays are, so samples would pass for small and be broadcast: the segments of a partition are
    what the join holds, and samples stream past them. If samples are ``made`` later, audio has n, their number, and source instead of them,
    and pieces have source, skip and n: n samples after the first skip of the source's.
    """
    held, size = ("source", F.col("n")) if made else ("samples", F.size("samples"))
    spans = lambda rows, end: F.explode(F.when(end > F.col("start"), F.sequence(F.expr(f"start div {block}"), F.expr(f"{rows} div {block}")))).alias("_bin")
    own = streams.select("*", spans("(start + n - 1)", F.col("start") + F.col("n")))
    heard = audio.select(REC, "start", held, size.cast("long").alias("_n")).select(REC, F.col("start").alias("_from"), held, "_n", spans("(start + _n - 1)", F.col("start") + F.col("_n")))
    rows = own.hint("shuffle_hash").join(heard, [REC, "_bin"])
    # A pair of a segment and a block of audio is taken once, in the first bin that both touch.
    first = F.greatest("start", "_from")
    rows = rows.withColumn("_a", first).withColumn("_z", F.least(F.col("start") + F.col("n"), F.col("_from") + F.col("_n")))
    rows = rows.filter((F.col("_a") < F.col("_z")) & (F.expr(f"_a div {block}") == F.col("_bin")))
    cut = ["source", F.expr("_a - _from").alias("skip"), F.expr("_z - _a").alias("n")] if made else [F.expr("slice(samples, cast(_a - _from as int) + 1, cast(_z - _a as int))").alias("samples")]
    return rows.select(REC, "speaker", "total", (F.col("at") + F.col("_a") - F.col("start")).alias("at"), *cut)


def frame_moments(pieces: DataFrame, rate: int, coefficients: int = 40, block: int = 65_536, sound: Callable[[Column], Column] | None = None) -> DataFrame:
    """(recording_id, speaker, i, heard, n, s, q): samples, frames, sum and sum of squares of the i-th of 3 x ``coefficients`` cepstra and differences.

    ``pieces`` has recording_id, speaker, total, at and samples. A speaker's audio is dealt in blocks; each gets, beyond its own samples, those
    that its frames and the frames two away need, so differences are those of the whole. A task holds one block; per-block sums are added up.
    With ``sound``, pieces have source, skip and n, and ``sound`` of a source are its samples: they are made where the frames are, after all shuffles.
    """
    size = "size(samples)" if sound is None else "n"
    before, after = (_REACH + 1) * HOP, (_REACH + 1) * HOP + SIZE
    low, high = f"greatest(0, (at - {after}) div {block})", f"(at + {size} - 1 + {before}) div {block}"
    dealt = pieces.withColumn("block", F.explode(F.sequence(F.expr(low), F.expr(high))))
    base = F.col("block") * block - before
    skip = F.greatest(F.lit(0), base - F.col("at"))
    kept = F.least(F.expr(size), base + block + before + after - F.col("at")) - skip
    dealt = dealt.withColumns({"_skip": skip.cast("int"), "_kept": kept.cast("int")}).filter("_kept > 0")
    own, at = [REC, "speaker", "block"], (F.col("at") + F.col("_skip")).alias("at")
    if sound is None:
        dealt = dealt.select(*own, "total", at, F.expr("slice(samples, _skip + 1, _kept)").alias("samples"))
    else:  # sources are so small that their bytes say nothing about the work: as many tasks as a shuffle has parts, and sorted as groups need it
        tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.select(*own, "total", at, "source", (F.col("skip") + F.col("_skip")).cast("int").alias("skip"), "_kept").repartition(tasks, *own).sortWithinPartitions(*own)
        dealt = dealt.select(*own, "total", "at", F.slice(sound(F.col("source")), F.col("skip") + 1, F.col("_kept")).alias("samples"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, total, b = (pdf[REC].iloc[0], pdf["speaker"].iloc[0]), int(pdf["total"].iloc[0]), int(pdf["block"].iloc[0])
        frames = 1 + max(0, total - SIZE) // HOP
        first, last = -(-b * block // HOP), min(frames, -(-(b + 1) * block // HOP))  # frames that begin in the block
        ends = pdf["at"] + pdf["samples"].map(len)
        heard = int((ends.clip(upper=(b + 1) * block) - pdf["at"].clip(lower=b * block)).clip(lower=0).sum())
        if first >= last:
            none = np.zeros(3 * coefficients)
            return pd.DataFrame({REC: [key[0]], "speaker": [key[1]], "heard": [heard], "n": [0], "s": [none], "q": [none]})
        a, z = max(0, first - _REACH), min(frames, last + _REACH)
        x = np.zeros((z - 1 - a) * HOP + SIZE)
        for at, own in zip(pdf["at"], pdf["samples"], strict=True):
            i = int(at) - a * HOP
            own = np.asarray(own, float)[max(0, -i) :]
            i = max(0, i)
            own = own[: max(0, len(x) - i)]
            x[i : i + len(own)] = own
        parts = [p[first - a : last - a] for p in cepstra(x, rate, coefficients)]
        y = np.concatenate(parts, axis=1)
        return pd.DataFrame({REC: [key[0]], "speaker": [key[1]], "heard": [heard], "n": [len(y)], "s": [y.sum(axis=0)], "q": [(y * y).sum(axis=0)]})

    found = dealt.groupBy(*own).applyInPandas(run, f"{REC} long, speaker string, heard long, n long, s array<double>, q array<double>")
    rows = found.select(REC, "speaker", "heard", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "m"))
    return rows.groupBy(REC, "speaker", "i").agg(F.sum("heard").alias("heard"), F.sum("n").alias("n"), F.sum("m.s").alias("s"), F.sum("m.q").alias("q"))


def voice_vectors(moments: DataFrame) -> DataFrame:
    """(recording_id, speaker, vector): means and deviations as ``mfcc_vector`` orders them."""
    mean = F.col("s") / F.col("n")
    rows = moments.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)), "_w": F.max("i").over(Window.partitionBy(REC, "speaker")) + 1})
    part = F.expr("i div (_w div 3)")
    flat = F.explode(F.array(F.struct(part.alias("p"), F.lit(0).alias("k"), F.col("i"), F.col("mean").alias("v")), F.struct(part.alias("p"), F.lit(1).alias("k"), F.col("i"), F.col("sd").alias("v"))))
    rows = rows.select(REC, "speaker", flat.alias("e")).groupBy(REC, "speaker").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select(REC, "speaker", F.col("e.v").alias("vector"))


def voice_pairs(segs: DataFrame, audio: DataFrame, conflicts: DataFrame | None = None, rate: int = 16_000, least_s: float = 5.0, coefficients: int = 40, block: int = 65_536, sound: Callable[[Column], Column] | None = None, most_s: float | None = None) -> DataFrame:
    """(recording_id, a, b, cosine, conflict, overlap, talk_a, talk_b) of a recording's speakers with ``least_s`` seconds of audio or more.

    ``audio`` has recording_id, start and samples, or with ``sound`` n and source, of which ``sound`` makes the n samples; ``conflicts`` recording_id, a and b (a before b) of profiles that cannot be one person.
    A speaker's whole audio counts; with ``most_s`` only its first seconds, as the reference stops at 90.
    The speakers of a recording are few, which bounds the pairs. What ``guarded_merges`` and ``merged_speakers`` take.
    """
    pieces = stream_pieces(speaker_streams(segs, rate, most_s), audio, block, sound is not None)
    vectors = settled(lambda: voice_vectors(frame_moments(pieces, rate, coefficients, block, sound).filter(F.col("heard") >= least_s * rate)), "voices")  # read for both sides of a pair
    talk = segs.groupBy(REC, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk"))
    rows = vectors.join(talk, [REC, "speaker"])
    side = lambda x: rows.select(REC, F.col("speaker").alias(x), F.col("vector").alias(f"v_{x}"), F.col("talk").alias(f"talk_{x}"))
    pairs = side("a").join(side("b"), REC).filter("a < b").withColumn("cosine", F.round(cosine(F.col("v_a"), F.col("v_b"), 1e-10), 4))
    pairs = pairs.join(speakers_overlap(segs).withColumn("overlap", F.lit(True)), [REC, "a", "b"], "left")
    pairs = pairs.withColumn("conflict", F.lit(None).cast("boolean")) if conflicts is None else pairs.join(conflicts.select(REC, "a", "b").distinct().withColumn("conflict", F.lit(True)), [REC, "a", "b"], "left")
    none = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return pairs.select(REC, "a", "b", "cosine", none("conflict"), none("overlap"), "talk_a", "talk_b")


def merged_voices(segs: DataFrame, audio: DataFrame, **kw) -> DataFrame:
    """(recording_id, seg_id, speaker): speakers merged whose audio is alike, labels anew by talk time."""
    return merged_speakers(segs, voice_pairs(segs, audio, **kw))
