"""Composite operators: diarization, refinement, indexing, chat retrieval, summaries and event replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.operators import folds, votes
from confab.operators import segments as s
from confab.operators.segments import REC
from confab.operators.text import char_windows, sliding_chunks, transcripts
from confab.sources.storage import written

#: Parameters of a transcription that may be set: fixed values.
PARAMETERS = (
    "vad_filter_threshold", "beam_size", "temperature", "no_speech_threshold", "compression_ratio_threshold",
    "chunk_minutes", "overlap_seconds", "adaptive_vad", "ipa_threshold",
)
#: Event kinds that end a session, and those that change what is shown: fixed values.
TERMINAL = ("result", "error", "cancelled")


def allowed_parameters(rows: DataFrame, allowed: tuple[str, ...] = PARAMETERS) -> DataFrame:
    """(recording_id, params) with only known, non-null parameters of the map ``params``."""
    return rows.select(REC, F.map_filter("params", lambda k, v: k.isin(*allowed) & v.isNotNull()).alias("params"))


def diarized(segs: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments with speakers by overlap with turns, carried over gaps, voted in short rows and labelled by talk time.

    A recording without turns has one speaker.
    """
    own = s.assign_speakers(segs, turns).select(REC, "seg_id", "carried")
    rows = segs.drop("speaker").join(own, [REC, "seg_id"]).withColumnRenamed("carried", "speaker")
    voted = votes.neighbour_vote(rows).select(REC, "seg_id", F.col("speaker").alias("voted"))
    rows = rows.drop("speaker").join(voted, [REC, "seg_id"]).withColumnRenamed("voted", "speaker").filter(F.trim("text") != "")
    labels = s.talk_time(rows).select(REC, "speaker", "label")
    return rows.join(labels, [REC, "speaker"]).drop("speaker").withColumnRenamed("label", "speaker")


def cut_pieces(segs: DataFrame, turns: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(recording_id, seg_id, source_id, start_ms, end_ms, text): segments cut at turn borders, numbered anew in order.

    A piece has the words (recording_id, seg_id, word_idx, word, start_ms) that begin in it; without any, the first piece keeps the whole
    text and later ones go. A segment that is not cut stays as it is.
    """
    cut = s.split_at_turns(segs, turns)
    old = segs.select(REC, "seg_id", "text", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    rows = old.join(cut, [REC, "seg_id"]).withColumn("_whole", (F.col("start_ms") == F.col("_s")) & (F.col("end_ms") == F.col("_e")))
    rows = rows.withColumn("_own", F.lit(None).cast("string"))
    if words is not None:
        met = words.select(REC, "seg_id", "word_idx", F.trim("word").alias("word"), F.col("start_ms").alias("_at")).join(cut, [REC, "seg_id"]).filter("_at >= start_ms and _at < end_ms")
        rows = rows.drop("_own").join(met.groupBy(REC, "seg_id", "piece").agg(s.joined_text("word_idx", "word").alias("_own")), [REC, "seg_id", "piece"], "left")
    text = F.when(F.col("_whole"), F.col("text")).otherwise(F.coalesce(F.trim("_own"), F.when(F.col("piece") == 0, F.col("text")), F.lit("")))
    rows = rows.withColumn("text", text).filter((F.trim("text") != "") | (F.col("piece") == 0) | F.col("_whole"))
    number = F.row_number().over(Window.partitionBy(REC).orderBy("seg_id", "piece")) - 1
    return rows.select(REC, number.alias("_n"), F.col("seg_id").alias("source_id"), "start_ms", "end_ms", "text").withColumnRenamed("_n", "seg_id")


def diarized_whole(segs: DataFrame, turns: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(recording_id, first_id, speaker, start_ms, end_ms, text): all passes of a diarization over ``segs``.

    Cut at turn borders, assigned by overlap and carried over gaps, numbered by talk time, short pieces voted by their neighbours, blank ones
    dropped, fragments of one sentence joined again. Numbers are given before the vote, as they stay. Without turns a recording has one speaker.
    """
    pieces = written(cut_pieces(segs, turns, words), "pieces")
    rows = pieces.join(s.assign_speakers(pieces, turns).select(REC, "seg_id", F.col("carried").alias("speaker")), [REC, "seg_id"])
    rows = rows.join(s.talk_time(rows).select(REC, "speaker", "label"), [REC, "speaker"]).drop("speaker").withColumnRenamed("label", "speaker")
    voted = votes.neighbour_vote(rows).select(REC, "seg_id", F.col("speaker").alias("voted"))
    rows = rows.join(voted, [REC, "seg_id"]).withColumn("speaker", F.col("voted")).filter(F.trim("text") != "")
    return folds.sentence_fragments(rows).withColumn("text", F.trim("text"))


def refined(segs: DataFrame, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(recording_id, seg_id, speaker): vote, then bridges, then a model's answers that name known speakers."""
    from confab.operators.models import accepted_speakers, ambiguous

    def put(rows, new):
        new = new.select(REC, "seg_id", F.col("speaker").alias("_s"))
        return rows.join(new, [REC, "seg_id"], "left").withColumn("speaker", F.coalesce("_s", "speaker")).drop("_s")

    rows = put(segs, votes.refined_vote(segs))
    rows = put(rows, votes.bridges(rows))
    if ask is not None:
        rows = put(rows, accepted_speakers(ask(ambiguous(rows)), rows))
    return rows


def index_entries(segs: DataFrame, most: int = 300) -> DataFrame:
    """(recording_id, chunk_id, text, segment_ids): the first chunks of each recording, ready to embed."""
    return sliding_chunks(segs).filter(F.col("chunk_id") < most).select(REC, "chunk_id", "text", F.sequence("first_idx", "last_idx").alias("segment_ids"))


def chat_context(hits: DataFrame, texts: DataFrame, fallback: DataFrame, chars: int = 3000) -> DataFrame:
    """(query_id, context): ``[i] text`` of the hits by rank, else the start of the transcript.

    ``hits`` has query_id, rank, doc_id; ``texts`` doc_id, text; ``fallback`` query_id, text for every query.
    """
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    found = hits.join(texts, "doc_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("found"))
    return fallback.join(found, "query_id", "left").select("query_id", F.coalesce("found", F.substring("text", 1, chars)).alias("context"))


def summarised(segs: DataFrame, model: Callable[[DataFrame], DataFrame], width: int = 6000, long_ms: int = 1_800_000) -> DataFrame:
    """(recording_id, summary): one call on a short text; else a call on each window and one on their answers.

    ``model`` maps (recording_id, part, prompt) to (recording_id, part, reply). A summary is the first
    three lines, 300 characters.
    """
    whole = transcripts(segs).join(segs.groupBy(REC).agg(F.max("end_ms").alias("ms")), REC)
    short = (F.col("ms") <= long_ms) | (F.length("text") <= width)
    parts = model(char_windows(whole.filter(~short), width).select(REC, F.col("window").alias("part"), F.col("chunk").alias("prompt")))
    joined = parts.groupBy(REC).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "reply"))), lambda x: x["reply"]), "\n"), 1, 12_000).alias("prompt"))
    last = whole.filter(short).select(REC, F.substring("text", 1, width).alias("prompt")).unionByName(joined)
    said = model(last.select(REC, F.lit(-1).alias("part"), "prompt"))
    return said.select(REC, F.substring(F.array_join(F.slice(F.split("reply", "\n"), 1, 3), " "), 1, 300).alias("summary"))


def routed(events: DataFrame, key: str = "user_id", kind: str = "event_type", order: str = "event_id", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(key, n_events, last_kind, ended, kinds): state of each session after its events; those after an end don't count."""
    end = F.min(F.when(F.col(kind).isin(*terminal), F.col(order))).over(Window.partitionBy(key))
    rows = events.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.max_by(kind, order).alias("last_kind"), F.bool_or(F.col("_end").isNotNull()).alias("ended"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def quality_sample(rows: DataFrame, most: int = 10, seed: int = 7) -> DataFrame:
    """Up to ``most`` changed translations of each recording, by a seeded hash: (recording_id, seg_id, text, text_pl)."""
    order = F.row_number().over(Window.partitionBy(REC).orderBy(F.xxhash64(F.lit(seed), "seg_id"), "seg_id"))
    return rows.filter("text_pl is not null and text_pl <> text").withColumn("_n", order).filter(F.col("_n") <= most).select(REC, "seg_id", "text", "text_pl")


def quality_verdict(scores: DataFrame, poor: float = 3.0, accept: float = 3.5) -> DataFrame:
    """(recording_id, average, worst, retranslate, recommended) of scored samples: needed below ``poor``, advised below ``accept``."""
    g = scores.groupBy(REC).agg(F.round(F.avg("score"), 4).alias("average"), F.min_by("seg_id", F.struct("score", "seg_id")).alias("worst"))
    return g.select(REC, "average", "worst", (F.col("average") < poor).alias("retranslate"), (F.col("average") < accept).alias("recommended"))
