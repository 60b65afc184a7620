"""Queries over event state, folds and signals, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.operators import folds, signal, votes
from confab.plans.segment_queries import _segs, _sql
from confab.sources import conversations as c
from confab.streaming import sessions as st
from confab.streaming import stateful as live


def _events(op):
    return lambda spark, d: op(c.table(spark, d, "events"))


def _labels(e):
    """The newest label wins: event_type by user, patched onto the first event of each user."""
    return st.patched_by_id(st.first_wins(e, ["user_id"], "event_id").select("user_id", "event_id", "event_type"), e.select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


def _appended(e):
    """Events up to the middle of each user's ids are there; all events arrive."""
    own = e.select("event_id", "user_id")
    middle = own.groupBy("user_id").agg(F.avg("event_id").alias("middle"))
    return st.appended(own.join(middle, "user_id").filter("event_id <= middle").select(*own.columns), own, ["event_id"])


def _names(e):
    """Every user has a name, and every event renames."""
    maps = e.select("user_id").distinct().withColumn("names", F.create_map(F.lit("seed"), F.lit("0")))
    out = st.upserted(maps, e.select("user_id", F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq")), "user_id")
    return out.select("user_id", F.explode("names").alias("name", "value"))


def _pcm(segs):
    """A waveform for each recording: a level per segment as 10 samples, silence between."""
    level = F.when(F.col("seg_id") % 5 == 0, 0.0).otherwise((F.col("end_ms") - F.col("start_ms")) / 25000.0)
    one = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when(i % 2 == 0, level).otherwise(-level))
    g = segs.withColumn("s", one).groupBy("recording_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "s"))), lambda x: x["s"])).alias("pcm"))
    return g


def _levels(segs):
    return segs.select("recording_id", F.col("seg_id").alias("frame_idx"), F.when(F.col("seg_id") % 4 < 2, 0.001).otherwise((F.col("end_ms") - F.col("start_ms")) / 25000.0).alias("rms"))


def _item_events(events):
    """Each user is a session; event types say what is set, the value's first digits which item, every 31st event resets."""
    kind = F.when(F.col("event_id") % 31 == 0, "reset").when(F.col("event_id") % 3 == 0, "append").when(F.col("event_id") % 3 == 1, "label").otherwise("translate")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("s"), (F.floor("value") % 5).cast("string")).alias("item"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("value"))


QUERIES = {
    "events_first_wins": _events(lambda e: st.first_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")),
    "events_latest": _events(lambda e: st.latest(e.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")),
    "events_append_unseen": _events(_appended),
    "labels_last_wins": _events(_labels),
    "names_upsert": _events(_names),
    "running_index": _events(lambda e: st.running_index(e.select("user_id", "event_id", (F.col("event_id") % 5).alias("size")), "user_id", "event_id", "size")),
    "event_log": _events(lambda e: st.event_log(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", ("click",))),
    "session_states": _events(st.session_states),
    "stream_item_states": _events(lambda e: st.replayed(_item_events(e), live.item_changes, "update", 6, ["session", "item"]).filter("n_events > 0")),
    "item_states": _events(lambda e: live.item_states(_item_events(e))),
    "stream_windowed_counts": _events(lambda e: st.replayed(e.select("ts", "event_type"), st.windowed_counts)),
    "neighbour_vote": _segs(votes.neighbour_vote),
    "refined_vote": _segs(votes.refined_vote),
    "speaker_bridges": _segs(votes.bridges),
    "sentence_fragments": _segs(folds.sentence_fragments),
    "loose_fragments": _segs(lambda s: folds.sentence_fragments(s, 400, 20_000, False)),
    "repetition_filter": _segs(lambda s: folds.without_repetitions(s, 2000)),
    "near_dup_fold": _segs(folds.without_near_duplicates),
    "buffered_chunks": _segs(lambda s: folds.buffered_chunks(s).withColumn("segment_ids", F.array_join(F.col("segment_ids").cast("array<string>"), ","))),
    "silence_regions": _segs(lambda s: signal.silence_regions(_levels(s), 1000, 0.005, 2000)),
    "speech_bounds": _segs(lambda s: signal.speech_bounds(_levels(s))),
    "vad_threshold": _segs(lambda s: signal.vad_threshold(_levels(s))),
    "audio_quality": _segs(lambda s: signal.audio_quality(_pcm(s), 10).withColumn("warnings", F.array_join("warnings", ",")).select("recording_id", *[F.round(x, 5).alias(x) for x in ("rms", "peak", "clip_ratio", "silence_ratio")], "warnings")),
    "signal_chunks": _segs(lambda s: signal.overlapping_chunks(s.groupBy("recording_id").agg(F.max("end_ms").alias("n")), 30_000, 2_000)),
    "waveform_peaks": _segs(lambda s: signal.waveform_peaks(_pcm(s), 16).select("recording_id", F.posexplode("peaks").alias("col", "peak"))),
    "snr_levels": _segs(lambda s: signal.snr(_levels(s)).withColumn("snr_db", F.round("snr_db", 5))),
}

_LEVELS = "levels AS (SELECT recording_id, seg_id AS frame_idx, CASE WHEN seg_id % 4 < 2 THEN 0.001::DOUBLE ELSE (end_ms - start_ms) / 25000.0::DOUBLE END AS rms FROM segments)"
_PCM = "pcm AS (SELECT recording_id, seg_id * 10 + i - 1 AS at_, abs(CASE WHEN seg_id % 5 = 0 THEN 0 ELSE (end_ms - start_ms) / 25000.0::DOUBLE END) AS x FROM segments, range(1, 11) r(i))"

_ITEMS = """SELECT session, item, arg_min(value, seq) FILTER (kind = 'append') AS text, arg_min(value, seq) FILTER (kind = 'translate') AS text_pl, arg_max(value, seq) FILTER (kind = 'label') AS speaker, count(*) AS n_events FROM (SELECT *, max(seq) FILTER (kind = 'reset') OVER (PARTITION BY session) AS since FROM (
  SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 31 = 0 THEN 'reset' WHEN event_id % 3 = 0 THEN 'append' WHEN event_id % 3 = 1 THEN 'label' ELSE 'translate' END AS kind, 's' || CAST(floor(value) % 5 AS INT) AS item, event_type || '-' || event_id AS value FROM events)) WHERE kind <> 'reset' AND seq > coalesce(since, -1) GROUP BY session, item"""

ORACLES = {
    "stream_item_states": _ITEMS,
    "item_states": _ITEMS,
    "events_first_wins": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL",
    "events_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "events_append_unseen": "SELECT event_id, user_id FROM events",
    "labels_last_wins": "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL",
    "names_upsert": "SELECT user_id, 'seed' AS name, '0' AS value FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, event_type, CAST(max(event_id) AS VARCHAR) FROM events GROUP BY ALL",
    "running_index": "SELECT user_id, event_id, event_id % 5 AS size, CAST(coalesce(sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM events",
    "event_log": "SELECT user_id, event_id, event_type, CAST(r AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'click') WHERE r <= 12",
    "session_states": "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s",
    "stream_windowed_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "silence_regions": _sql("SELECT recording_id, min(frame_idx) * 1000 AS start_ms, (max(frame_idx) + 1) * 1000 AS end_ms FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS g FROM levels WHERE rms < 0.005) GROUP BY recording_id, g HAVING count(*) >= 2", _LEVELS),
    "speech_bounds": _sql("SELECT recording_id, CASE WHEN w THEN 0 ELSE greatest(0, a * 50 - 500) END AS start_ms, CASE WHEN w THEN n ELSE least(n, (b + 1) * 50 + 500) END AS end_ms FROM (SELECT *, a IS NULL OR n < 2000 AS w FROM (SELECT recording_id, min(frame_idx) FILTER (rms >= 0.01) AS a, max(frame_idx) FILTER (rms >= 0.01) AS b, (max(frame_idx) + 1) * 50 AS n FROM levels GROUP BY ALL))", _LEVELS),
    "vad_threshold": _sql("SELECT recording_id, CASE WHEN m < 0.005 THEN 0.15 WHEN m < 0.02 THEN 0.19 WHEN x > 0.3 AND x > 8 * m THEN 0.30 ELSE 0.25 END::DOUBLE AS threshold FROM (SELECT recording_id, quantile_cont(rms, 0.5) AS m, max(rms) AS x FROM levels GROUP BY ALL)", _LEVELS),
    "signal_chunks": _sql("SELECT recording_id, CAST(i AS INT) AS chunk, i * 28000 AS start, least(i * 28000 + 30000, n) AS end FROM (SELECT recording_id, n, unnest(range((n - 1) // 28000 + 1)) AS i FROM (SELECT recording_id, max(end_ms) AS n FROM segments GROUP BY ALL)) WHERE i = 0 OR i * 28000 + 2000 < n"),
    "waveform_peaks": _sql("SELECT recording_id, CAST(at_ // b AS INT) AS col, max(x) AS peak FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY recording_id) // least(16, count(*) OVER (PARTITION BY recording_id))) AS b FROM pcm) WHERE at_ // b < 16 GROUP BY ALL", _PCM),
    "audio_quality": _sql(
        """SELECT recording_id, round(sqrt(sum(x * x) / count(*)), 5) AS rms, round(max(x), 5) AS peak, round(avg(CASE WHEN x > 0.98 THEN 1.0 ELSE 0.0 END), 5) AS clip_ratio, round(coalesce(max(silence), 0), 5) AS silence_ratio,
  concat_ws(',', CASE WHEN avg(CASE WHEN x > 0.98 THEN 1.0 ELSE 0.0 END) > 0.001 THEN 'clipping' END, CASE WHEN sqrt(sum(x * x) / count(*)) < 0.01 THEN 'quiet' END, CASE WHEN coalesce(max(silence), 0) > 0.65 THEN 'silence' END, CASE WHEN max(x) > 0 AND 20 * log10(max(x) / (sqrt(sum(x * x) / count(*)) + 1e-10)) < 6 THEN 'flat' END) AS warnings
FROM pcm LEFT JOIN (SELECT recording_id, avg(CASE WHEN e < p THEN 1.0 ELSE 0.0 END) AS silence FROM frames_ JOIN (SELECT recording_id, quantile_cont(e, 0.2) AS p FROM frames_ GROUP BY ALL) USING (recording_id) GROUP BY recording_id) USING (recording_id) GROUP BY recording_id""",
        _PCM,
        "frames_ AS (SELECT recording_id, at_ // 10 AS frame_idx, pow(sqrt(sum(x * x) / 10), 2) AS e FROM (SELECT *, max(at_) OVER (PARTITION BY recording_id) AS top FROM pcm) WHERE at_ // 10 < top // 10 GROUP BY ALL)",
    ),
    "snr_levels": _sql(
        """SELECT recording_id, round(db, 5) AS snr_db, CASE WHEN db IS NULL THEN 'cisza' WHEN db < 10 THEN 'niski (szum)' WHEN db < 25 THEN 'sredni' ELSE 'wysoki (czysty)' END AS label FROM (SELECT recording_id, CASE WHEN s < 1e-9 THEN NULL WHEN q < 1e-9 THEN 40.0 ELSE greatest(0, least(60, 20 * log10(s / q))) END::DOUBLE AS db
  FROM (SELECT recording_id, sqrt(avg(rms * rms)) AS s, avg(rms) FILTER (r <= greatest(1, n // 10)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY rms, frame_idx) AS r, count(*) OVER (PARTITION BY recording_id) AS n FROM levels) GROUP BY ALL))""",
        _LEVELS,
    ),
}
