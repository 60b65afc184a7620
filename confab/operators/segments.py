"""Relational operators on timed segments, words and turns; everything is partitioned by recording.

Times are milliseconds. Ties are broken by position, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import clock

REC = "recording_id"
#: Speaker label of the engine's output: fixed format.
LABEL = "GŁOS_%02d"
#: One-word reactions: fixed values.
INTERJECTIONS = (
    "tak", "nie", "mhm", "aha", "ok", "okay", "no", "hm", "hmm", "eh", "ach", "och", "oj", "uff", "he", "ha", "e", "ee",
    "dobrze", "jasne", "rozumiem", "oczywiście", "właśnie", "yes", "yeah", "right", "sure", "uh", "um",
)


def by_id():
    """Segments of a recording in order."""
    return Window.partitionBy(REC).orderBy("seg_id")


def so_far():
    """The same, up to the row itself."""
    return by_id().rowsBetween(Window.unboundedPreceding, 0)


def shown_text(segs: DataFrame) -> Column:
    """The translation where there is one, else the text; trimmed, never null."""
    own = F.col("text") if "text_pl" not in segs.columns else F.coalesce(F.nullif("text_pl", F.lit("")), F.col("text"))
    return F.trim(F.coalesce(own, F.lit("")))


def joined_text(order: str = "seg_id", text: str = "text", sep: str = " ") -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), sep)


def merge_islands(segs: DataFrame, gap_ms: int = 50) -> DataFrame:
    """Neighbours of one speaker at most ``gap_ms`` apart become one; it ends where its last row ends."""
    prev_end, prev_speaker = F.lag("end_ms").over(by_id()), F.lag("speaker").over(by_id())
    opens = F.when((F.col("speaker") == prev_speaker) & (F.col("start_ms") - prev_end <= gap_ms), 0).otherwise(1)
    rows = segs.withColumn("_open", opens).withColumn("island", F.sum("_open").over(so_far()) - 1)
    return rows.groupBy(REC, F.col("island").cast("int").alias("island")).agg(
        F.min_by("speaker", "seg_id").alias("speaker"), F.min_by("start_ms", "seg_id").alias("start_ms"), F.max_by("end_ms", "seg_id").alias("end_ms"),
        joined_text().alias("text"), F.count(F.lit(1)).alias("n_segments"),
    )


def talk_time(segs: DataFrame, speaker: str = "speaker", order: str = "seg_id") -> DataFrame:
    """(recording_id, speaker, talk_ms, share, rank, label): rank by talk time, ties by first appearance."""
    by = segs.groupBy(REC, F.col(speaker).alias("speaker")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.min(order).alias("first"))
    whole = F.greatest(F.sum("talk_ms").over(Window.partitionBy(REC)), F.lit(1000))
    rank = F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("talk_ms"), "first"))
    return by.withColumns({"share": F.round(F.col("talk_ms") / whole, 6), "rank": rank, "label": F.format_string(LABEL, rank)}).drop("first")


def confidence(words: DataFrame) -> DataFrame:
    """(recording_id, seg_id, n_words, prob_sum, confidence): mean word probability to 3 digits."""
    g = words.groupBy(REC, "seg_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("prob_pct").alias("prob_sum"))
    return g.withColumn("confidence", F.expr("(20 * prob_sum + n_words) div (2 * n_words)") / 1000.0)


def confidence_bucket(conf: Column) -> Column:
    return F.when(conf < 0.5, "red").when(conf < 0.7, "amber")


def quality_report(segs: DataFrame, words: DataFrame) -> DataFrame:
    """A row per recording: mean word probability, problem counts, warnings and whether to transcribe again."""
    conf = confidence(words)
    rows = segs.join(conf, [REC, "seg_id"], "left")
    same, prev = F.lower(F.trim("text")), F.lag(F.lower(F.trim("text"))).over(by_id())
    gap = F.col("start_ms") - F.lag("end_ms").over(by_id())
    rows = rows.withColumns({"_rep": (same == prev) & (same != ""), "_gap": gap > 10_000})
    g = rows.groupBy(REC).agg(
        F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.sum("prob_sum"), F.lit(0)).alias("_p"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("_w"),
        F.count_if(F.col("prob_sum") < 55 * F.col("n_words")).alias("low_confidence"), F.count_if(F.col("end_ms") - F.col("start_ms") < 400).alias("very_short"),
        F.count_if("_rep").alias("repetitions"), F.count_if("_gap").alias("long_gaps"),
    )
    mean = F.when(F.col("_w") > 0, F.expr("(20 * _p + _w) div (2 * _w)") / 1000.0).otherwise(1.0)  # to 3 digits, before the thresholds
    warn = F.array_compact(F.array(F.when(mean < 0.65, "low_average"), F.when(F.col("low_confidence") > 0.2 * F.col("n_segments"), "many_low"), F.when(F.col("repetitions") > 3, "repetitions"), F.when(F.col("long_gaps") > 0, "gaps")))
    return g.withColumns({"avg_confidence": mean, "warnings": F.array_join(warn, ","), "retranscribe": (mean < 0.6) | (F.col("repetitions") > 5)}).drop("_p", "_w")


def tags(segs: DataFrame, words: DataFrame) -> DataFrame:
    """(recording_id, seg_id, tags): interjection, check-speaker, question, low-conf, long, silence-gap, ipa.

    The translated text (``text_pl``), where there is one, is tagged before the original; only an
    interjection between two rows of one other speaker asks to check its speaker; ``words`` may have ``ipa``.
    """
    rows = segs.join(confidence(words).select(REC, "seg_id", "prob_sum", "n_words"), [REC, "seg_id"], "left")
    text = F.trim(F.coalesce(F.nullif("text_pl", F.lit("")), "text") if "text_pl" in segs.columns else F.col("text"))
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))
    if "ipa" in words.columns:
        rows = rows.join(words.filter("ipa <> ''").select(REC, "seg_id", F.lit(True).alias("_ipa")).distinct(), [REC, "seg_id"], "left")
    else:
        rows = rows.withColumn("_ipa", F.lit(False))
    left, right = F.lag("speaker").over(by_id()), F.lead("speaker").over(by_id())
    gap = F.col("start_ms") - F.lag("end_ms").over(by_id())
    found = F.array(
        F.when(bare.isin(*INTERJECTIONS), "interjection"), F.when(bare.isin(*INTERJECTIONS) & (left == right) & (left != F.col("speaker")), "check-speaker"), F.when(text.endswith("?"), "question"),
        F.when(F.col("prob_sum") < 55 * F.col("n_words"), "low-conf"), F.when(F.col("end_ms") - F.col("start_ms") > 20_000, "long"), F.when(gap > 3000, "silence-gap"), F.when(F.col("_ipa"), "ipa"),
    )
    return rows.select(REC, "seg_id", F.array_compact(found).alias("tags"))


def tag_summary(tagged: DataFrame) -> DataFrame:
    """(tag, n, n_recordings)."""
    return tagged.select(REC, F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(REC).alias("n_recordings"))


def binned(rows: DataFrame, bin_ms: int) -> DataFrame:
    """A row for each time bin that an interval touches, for interval joins by equal bins."""
    return rows.withColumn("_bin", F.explode(F.sequence(F.expr(f"start_ms div {bin_ms}"), F.expr(f"greatest(start_ms, end_ms) div {bin_ms}"))))


def overlaps(segs: DataFrame, turns: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """(recording_id, seg_id, turn_idx, speaker_raw, overlap_ms): interval join of positive overlaps.

    Both sides meet in time bins, so a long recording is many keys; a pair counts in the bin where its overlap begins.
    """
    t = binned(turns.select(REC, "turn_idx", "speaker_raw", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "start_ms", "end_ms"), bin_ms).drop("start_ms", "end_ms")
    s = binned(segs.select(REC, "seg_id", "start_ms", "end_ms"), bin_ms)
    begin = F.greatest("start_ms", "t0")
    both = s.join(t, [REC, "_bin"]).filter((F.least("end_ms", "t1") > begin) & (F.col("_bin") == F.floor(begin / bin_ms)))
    return both.select(REC, "seg_id", "turn_idx", "speaker_raw", (F.least("end_ms", "t1") - begin).alias("overlap_ms"))


def assign_speakers(segs: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, seg_id, assigned, carried): speaker of the largest total overlap; gaps take the last one.

    An overlap must reach 1 % (short segments) or 5 % of the segment; ties go to the first turn; before
    the first assignment the first assigned speaker holds, and without any the first label.
    """
    g = overlaps(segs, turns).groupBy(REC, "seg_id", "speaker_raw").agg(F.sum("overlap_ms").alias("ms"), F.min("turn_idx").alias("first"))
    best = g.groupBy(REC, "seg_id").agg(F.max_by(F.struct("speaker_raw", "ms"), F.struct(F.col("ms"), -F.col("first"))).alias("best"))
    rows = segs.join(best, [REC, "seg_id"], "left")
    dur = F.col("end_ms") - F.col("start_ms")
    enough = F.col("best.ms") * 100 >= dur * F.when(dur < 500, 1).otherwise(5)
    rows = rows.select(REC, "seg_id", F.when(enough, F.col("best.speaker_raw")).alias("assigned"))
    first = F.first("assigned", ignorenulls=True).over(by_id().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("carried", F.coalesce(F.last("assigned", ignorenulls=True).over(so_far()), first, F.lit(LABEL % 1)))


def gap_speakers(segs: DataFrame, gap_ms: int = 1500, speakers: int = 6) -> DataFrame:
    """(recording_id, seg_id, speaker_no): the next of ``speakers`` after each gap of ``gap_ms``."""
    change = F.when(F.col("start_ms") - F.lag("end_ms").over(by_id()) >= gap_ms, 1).otherwise(0)
    return segs.withColumn("_c", change).select(REC, "seg_id", (F.sum("_c").over(so_far()) % speakers).cast("int").alias("speaker_no"))


def overlap_flags(turns: DataFrame) -> DataFrame:
    """(recording_id, turn_idx, overlapping, overlap_with, overlap_sec) against the turn before only.

    The overlap is counted to the end of the turn before, even where this one ends earlier; that turn's speaker is named
    by the label of their talk time, ties to the first heard.
    """
    w = Window.partitionBy(REC).orderBy("start_ms", "turn_idx")
    talk = turns.groupBy(REC, "speaker_raw").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.min(F.struct("start_ms", "turn_idx")).alias("first"))
    labels = talk.select(REC, "speaker_raw", F.format_string(LABEL, F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("ms"), "first"))).alias("_label"))
    rows = turns.join(labels, [REC, "speaker_raw"])
    end, who = F.lag("end_ms").over(w), F.lag("_label").over(w)
    flag = F.coalesce(F.col("start_ms") < end, F.lit(False))
    return rows.select(REC, "turn_idx", flag.alias("overlapping"), F.when(flag, who).alias("overlap_with"), F.when(flag, F.round((end - F.col("start_ms")) / 1000.0, 3)).alias("overlap_sec"))


def min_speaker_share(turns: DataFrame) -> DataFrame:
    """(recording_id, min_share): share of the quietest speaker."""
    g = turns.groupBy(REC, "speaker_raw").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return g.groupBy(REC).agg(F.round(F.coalesce(F.min("ms") / F.nullif(F.sum("ms"), F.lit(0)), F.lit(0.0)), 6).alias("min_share"))


def hallucinations(segs: DataFrame, words: DataFrame) -> DataFrame:
    """(recording_id, seg_id, reason): too fast for its length, or unsure and short; without words it is sure."""
    rows = segs.join(confidence(words).select(REC, "seg_id", "prob_sum", "n_words"), [REC, "seg_id"], "left")
    dur, n = F.col("end_ms") - F.col("start_ms"), F.coalesce("n_words", F.lit(0))
    fast = (n * 1000 > 12 * F.greatest(dur, F.lit(50))) & (dur < 1000)
    unsure = (F.col("prob_sum") < 12 * F.col("n_words")) & (dur < 2000)
    low = (F.col("prob_sum") < 30 * F.col("n_words")) & (dur < 1500)
    return rows.withColumn("reason", F.when(fast, "too_fast").when(unsure, "unsure").when(low, "low_confidence")).filter("reason is not null").select(REC, "seg_id", "reason")


def output_rows(segs: DataFrame) -> DataFrame:
    """Rows with text, numbered anew from 0; an empty translation falls back to the text."""
    pl = F.col("text_pl") if "text_pl" in segs.columns else F.lit(None).cast("string")
    return segs.filter(F.trim("text") != "").select(REC, (F.row_number().over(by_id()) - 1).alias("new_id"), "seg_id", "speaker", "text", F.coalesce(F.nullif(pl, F.lit("")), F.col("text")).alias("text_pl"))


def replace_range(segs: DataFrame, new: DataFrame, start_ms: int, end_ms: int, midpoint: bool = False) -> DataFrame:
    """Rows whose start (or midpoint) lies in [start, end) give way to ``new``; order by start, ids anew."""
    at = (F.col("start_ms") + F.col("end_ms")) / 2 if midpoint else F.col("start_ms")
    cols = [REC, "seg_id", "speaker", "text", "start_ms", "end_ms"]
    rows = segs.filter((at < start_ms) | (at >= end_ms)).select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    order = Window.partitionBy(REC).orderBy("start_ms", "_new", "seg_id")
    return rows.withColumn("new_id", F.row_number().over(order) - 1).select(REC, "new_id", "speaker", "text", "start_ms", "end_ms")


def reassign_by_overlap(segs: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, seg_id, speaker): the turn of the largest single overlap, else unchanged."""
    best = overlaps(segs, turns).groupBy(REC, "seg_id").agg(F.max_by("speaker_raw", F.struct(F.col("overlap_ms"), -F.col("turn_idx"))).alias("found"))
    return segs.join(best, [REC, "seg_id"], "left").select(REC, "seg_id", F.coalesce("found", "speaker").alias("speaker"))


def speakers_overlap(segs: DataFrame, tolerance_ms: int = 200) -> DataFrame:
    """(recording_id, a, b): speakers with intervals that overlap by more than the tolerance.

    A sweep over each two speakers' intervals by start: the furthest end of the one so far decides whether the other's next interval
    overlaps any of them. A row is there once for each other speaker of its recording, a few tens by nature; a crowded minute costs no more than a quiet one.
    """
    rows = segs.filter("speaker is not null and start_ms is not null and end_ms is not null").select(REC, "speaker", "start_ms", "end_ms")
    others = rows.groupBy(REC).agg(F.collect_set("speaker").alias("_all"))
    rows = rows.join(others, REC).select(REC, "speaker", "start_ms", "end_ms", F.explode("_all").alias("_o")).filter("speaker <> _o")
    first = F.col("speaker") < F.col("_o")
    rows = rows.select(REC, F.least("speaker", "_o").alias("a"), F.greatest("speaker", "_o").alias("b"), first.alias("_f"), "start_ms", "end_ms")
    before = Window.partitionBy(REC, "a", "b").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.when(F.col("_f"), F.max(F.when(~F.col("_f"), F.col("end_ms"))).over(before)).otherwise(F.max(F.when(F.col("_f"), F.col("end_ms"))).over(before))
    return rows.withColumn("_e", furthest).filter(F.least("_e", "end_ms") - F.col("start_ms") > tolerance_ms).filter("_e is not null").select(REC, "a", "b").distinct()


def active_at(segs: DataFrame, points: DataFrame) -> DataFrame:
    """As-of join: (recording_id, t_ms, seg_id) with the last segment that starts at or before each point.

    Union and one window instead of pairs: a sort per recording.
    """
    rows = segs.select(REC, F.col("start_ms").alias("t_ms"), "seg_id", F.lit(0).alias("_p")).unionByName(points.select(REC, "t_ms", F.lit(None).cast("int").alias("seg_id"), F.lit(1).alias("_p")))
    w = Window.partitionBy(REC).orderBy("t_ms", "_p", "seg_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seg_id", F.last("seg_id", ignorenulls=True).over(w)).filter("_p = 1").select(REC, "t_ms", "seg_id")


def nearest_to(segs: DataFrame, points: DataFrame) -> DataFrame:
    """(recording_id, t_ms, seg_id): smallest distance of the start, ties to the first segment."""
    rows = segs.select(REC, F.col("start_ms").alias("t_ms"), F.struct("start_ms", "seg_id").alias("s"), F.lit(0).alias("_p")).unionByName(points.select(REC, "t_ms", F.lit(None).cast("struct<start_ms:bigint,seg_id:int>").alias("s"), F.lit(1).alias("_p")))
    down = Window.partitionBy(REC).orderBy("t_ms", "_p").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(REC).orderBy(F.desc("t_ms"), "_p").rowsBetween(Window.unboundedPreceding, 0)
    first = rows.filter("_p = 0").groupBy(REC, "t_ms").agg(F.min("s").alias("s")).withColumn("_p", F.lit(0)).unionByName(rows.filter("_p = 1"))
    both = first.withColumns({"before": F.last("s", ignorenulls=True).over(down), "after": F.last("s", ignorenulls=True).over(up)}).filter("_p = 1")
    dist = lambda s: F.struct(F.abs(s["start_ms"] - F.col("t_ms")).alias("d"), s["seg_id"].alias("seg_id"))
    pick = F.array_min(F.array_compact(F.array(F.when(F.col("before").isNotNull(), dist(F.col("before"))), F.when(F.col("after").isNotNull(), dist(F.col("after"))))))
    return both.select(REC, "t_ms", pick["seg_id"].alias("seg_id"))


def context(segs: DataFrame, k: int = 3) -> DataFrame:
    """(recording_id, seg_id, n_context, context): the ``k`` segments on either side and itself, joined."""
    own = F.collect_list("text").over(by_id().rowsBetween(-k, k))
    return segs.select(REC, "seg_id", F.size(own).alias("n_context"), F.array_join(own, " ").alias("context"))


def timeline(segs: DataFrame) -> DataFrame:
    """(recording_id, seg_id, left_pct, width_pct): places on a bar of the whole recording; width 0.3 at least."""
    whole = F.greatest(F.max("end_ms").over(Window.partitionBy(REC)), F.lit(1))
    return segs.select(REC, "seg_id", F.round(F.col("start_ms") * 100 / whole, 4).alias("left_pct"), F.round(F.greatest((F.col("end_ms") - F.col("start_ms")) * 100 / whole, F.lit(0.3)), 4).alias("width_pct"))


def speaker_lists(segs: DataFrame) -> DataFrame:
    """(recording_id, speakers, duration_ms): distinct speakers in order, end of the last segment."""
    return segs.groupBy(REC).agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.max_by("end_ms", "seg_id").alias("duration_ms"))


def translated_counts(segs: DataFrame) -> DataFrame:
    """(recording_id, n_translated): rows whose translation is there and is not the text itself."""
    return segs.groupBy(REC).agg(F.count_if((F.col("text_pl") != "") & ~F.col("text_pl").eqNullSafe(F.col("text"))).alias("n_translated"))


def context_lines(segs: DataFrame, names: DataFrame, tags: DataFrame, last: int = 150, speaker: str | None = None) -> DataFrame:
    """(recording_id, n_rows, transcript): lines ``[m:ss name] [tags] text`` of the last rows, of one ``speaker`` or all.

    ``names`` has recording_id, speaker, name; ``tags`` recording_id, seg_id and an array tags (a row with an empty one shows ``[]``). Without a
    name the speaker's label is shown, without that ``?``; the text is the translation where there is one, trimmed.
    """
    rows = segs if speaker is None else segs.filter(F.col("speaker") == speaker)
    back = F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("seg_id")))
    rows = rows.withColumn("_text", shown_text(rows)).withColumn("_back", back).filter(F.col("_back") <= last)
    rows = rows.join(names.select(REC, "speaker", F.col("name").alias("_name")), [REC, "speaker"], "left").join(tags.select(REC, "seg_id", F.col("tags").alias("_tags")), [REC, "seg_id"], "left")
    head = F.concat(F.lit("["), clock(F.coalesce("start_ms", F.lit(0))), F.lit(" "), F.coalesce("_name", "speaker", F.lit("?")), F.lit("]"))
    line = F.concat(head, F.coalesce(F.concat(F.lit(" ["), F.array_join("_tags", ", "), F.lit("]")), F.lit("")), F.lit(" "), F.trim(F.coalesce("_text", F.lit(""))))
    return rows.withColumn("_line", line).groupBy(REC).agg(F.count(F.lit(1)).alias("n_rows"), joined_text("seg_id", "_line", "\n").alias("transcript"))


def turn_words(segs: DataFrame, words: DataFrame, turns: DataFrame, slack_ms: int = 30) -> DataFrame:
    """(recording_id, turn_idx, n_words, text): words that start in [start - slack, end + slack) of the segment's own turn."""
    n = F.count(F.lit(1)).over(Window.partitionBy(REC, "seg_id"))
    w = words.join(segs.select(REC, "seg_id", F.col("turn").cast("int").alias("turn_idx"), F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")), [REC, "seg_id"]).withColumn("n", n)
    w = w.withColumn("at", F.col("s0") + F.expr("((s1 - s0) * word_idx) div n"))
    rows = w.join(turns.select(REC, "turn_idx", "start_ms", "end_ms"), [REC, "turn_idx"]).filter((F.col("at") >= F.col("start_ms") - slack_ms) & (F.col("at") < F.col("end_ms") + slack_ms))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "word_idx", "word"))), lambda s: s["word"]), " ")
    return rows.groupBy(REC, "turn_idx").agg(F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def display_names(speakers: DataFrame) -> DataFrame:
    """(recording_id, speaker, display): given name, else a counter per kind over the sorted speakers.

    ``speakers`` has recording_id, speaker, name and gender.
    """
    kind = F.when(F.col("gender") == "zenski", "Kobieta").when(F.col("gender") == "meski", "Mężczyzna").when(F.col("gender") == "dziecko", "Dziecko").otherwise("Osoba")
    rows = speakers.withColumns({"_kind": kind, "_no": F.col("name").isNull() | (F.trim("name") == "")})
    nth = F.row_number().over(Window.partitionBy(REC, "_no", "_kind").orderBy("speaker"))
    return rows.select(REC, "speaker", F.when(F.col("_no"), F.concat_ws("_", "_kind", nth.cast("string"))).otherwise(F.col("name")).alias("display"))


def recent_transcript(segs: DataFrame, last: int = 40, chars: int = 5000) -> DataFrame:
    """(recording_id, n_rows, transcript): of the last rows, lines up to the first beyond ``chars``."""
    back = F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("seg_id")))
    rows = segs.withColumn("_back", back).filter(F.col("_back") <= last).withColumn("line", F.concat_ws(": ", "speaker", "text"))
    before = F.coalesce(F.sum(F.length("line")).over(by_id().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_sum", before).filter(F.col("_sum") <= chars).groupBy(REC).agg(F.count(F.lit(1)).alias("n_rows"), joined_text("seg_id", "line", "\n").alias("transcript"))


def split_at_turns(segs: DataFrame, turns: DataFrame, least_ms: int = 100, bin_ms: int = 60_000) -> DataFrame:
    """(recording_id, seg_id, piece, start_ms, end_ms): segments cut at the midpoints between turns; slivers of a cut go, whole segments stay."""
    w = Window.partitionBy(REC).orderBy("start_ms", "turn_idx")
    cuts = turns.withColumn("next", F.lead("start_ms").over(w)).filter("next is not null").select(REC, F.expr("(end_ms + next) div 2").alias("cut"))
    cuts = cuts.withColumn("_bin", F.expr(f"cut div {bin_ms}"))
    inside = binned(segs.select(REC, "seg_id", "start_ms", "end_ms"), bin_ms).join(cuts, [REC, "_bin"]).filter("cut > start_ms and cut < end_ms")
    inside = inside.groupBy(REC, "seg_id").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    rows = segs.join(inside, [REC, "seg_id"], "left").withColumn("edges", F.concat(F.array("start_ms"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array("end_ms")))
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.struct(F.get("edges", i).alias("s"), F.get("edges", i + 1).alias("e"))))
    rows = rows.select(REC, "seg_id", "edges", pieces.alias("piece", "p")).filter((F.size("edges") == 2) | (F.col("p.e") - F.col("p.s") >= least_ms))
    return rows.select(REC, "seg_id", "piece", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"))


def energy_speakers(segs: DataFrame, gap_ms: int = 1500, ratio: float = 4.0, speakers: int = 6) -> DataFrame:
    """(recording_id, seg_id, speaker_no): the next speaker after a gap or where the energy changes ``ratio`` times.

    ``segs`` has a column energy; where either is zero the ratio is 1.
    """
    before = F.lag("energy").over(by_id())
    change = F.when((before > 0) & (F.col("energy") > 0), F.greatest(before, "energy") / F.least(before, "energy")).otherwise(1.0)
    flag = F.when((F.col("start_ms") - F.lag("end_ms").over(by_id()) >= gap_ms) | (change >= ratio), 1).otherwise(0)
    return segs.withColumn("_c", flag).select(REC, "seg_id", (F.sum("_c").over(so_far()) % speakers).cast("int").alias("speaker_no"))


def quote_lines(segs: DataFrame, least_ms: int = 300_000, rows: int = 60, chars: int = 3000) -> DataFrame:
    """(recording_id, block): ``[m:ss name] text`` of the first segments of recordings long enough, cut to ``chars``."""
    from confab.functions.text import clock

    ends = F.max("end_ms").over(Window.partitionBy(REC))
    nth = F.row_number().over(by_id())
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" "), F.col("speaker"), F.lit("] "), F.col("text"))
    own = segs.withColumns({"_ends": ends, "_n": nth, "line": line}).filter((F.col("_ends") >= least_ms) & (F.col("_n") <= rows))
    return own.groupBy(REC).agg(F.substring(joined_text("seg_id", "line", "\n"), 1, chars).alias("block"))


def neighbour_texts(segs: DataFrame, ids: DataFrame) -> DataFrame:
    """(recording_id, seg_id, before, text, after) of the segments named in ``ids`` (recording_id, seg_id)."""
    rows = segs.select(REC, "seg_id", F.lag("text").over(by_id()).alias("before"), "text", F.lead("text").over(by_id()).alias("after"))
    return rows.join(ids, [REC, "seg_id"], "left_semi")


def unsure_words(words: DataFrame, below: int = 40) -> DataFrame:
    """(recording_id, seg_id, n, marked): words below the probability, for the phonetic boundary, in order."""
    own = words.filter(F.col("prob_pct") < below)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda s: s["word"]), " ")
    return own.groupBy(REC, "seg_id").agg(F.count(F.lit(1)).alias("n"), text.alias("marked"))
