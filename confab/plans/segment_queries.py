"""Queries over timed segments and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.operators import segments as s
from confab.sources import conversations as c


def _base(spark, sf_dir):
    conv = c.table(spark, sf_dir, "conversations")
    segs = c.segments(conv)
    return conv, segs


def _segs(op):
    return lambda spark, d: op(_base(spark, d)[1])


def _segs_words(op):
    def run(spark, d):
        segs = _base(spark, d)[1]
        return op(segs, c.words(segs))

    return run


def _segs_turns(op):
    def run(spark, d):
        conv, segs = _base(spark, d)
        return op(segs, c.turns(segs, conv))

    return run


def _turns(op):
    return _segs_turns(lambda segs, turns: op(turns))


def _points(turns):
    return turns.select("recording_id", (F.col("start_ms") + 700).alias("t_ms")).distinct()


def _fragment(segs):
    """New rows for 20 s to 40 s of each recording: the old ones marked, 5 ms later."""
    own = segs.filter("start_ms >= 20000 and start_ms < 40000")
    return own.withColumns({"text": F.concat(F.lit("again "), "text"), "start_ms": F.col("start_ms") + 5, "end_ms": F.col("end_ms") + 5})


def _tagged(segs, words):
    """Every fifth row is translated, to a reaction or a question; very sure words have a phonetic mark."""
    pl = F.when(F.col("seg_id") % 10 == 5, "Mhm!").when(F.col("seg_id") % 5 == 0, F.concat("text", F.lit("?")))
    return s.tags(segs.withColumn("text_pl", pl), words.withColumn("ipa", F.when(F.col("prob_pct") > 97, "x")))


def _named(segs):
    """Every third recording names its users; kinds follow the speaker."""
    rows = segs.select("recording_id", "speaker").distinct()
    return rows.withColumns({"name": F.when((F.col("recording_id") % 3 == 0) & (F.col("speaker") == "user"), "Ada"), "gender": F.when(F.col("speaker") == "assistant", "zenski").when(F.col("speaker") == "user", "meski")})


QUERIES = {
    "segments_view": _segs(lambda x: x),
    "turns_view": _turns(lambda t: t),
    "seg_merge_islands": _segs(s.merge_islands),
    "speaker_talk_share": _segs(lambda x: s.talk_time(s.merge_islands(x), order="island")),
    "segment_confidence": _segs_words(lambda x, w: s.confidence(w).withColumn("bucket", s.confidence_bucket(F.col("confidence")))),
    "quality_report": _segs_words(s.quality_report),
    "segment_tags": _segs_words(lambda x, w: _tagged(x, w).withColumn("tags", F.array_join("tags", ","))),
    "tag_summary": _segs_words(lambda x, w: s.tag_summary(_tagged(x, w))),
    "seg_overlap_pairs": _segs_turns(s.overlaps),
    "seg_overlap_assign": _segs_turns(s.assign_speakers),
    "speaker_renumber": _segs_turns(lambda x, t: s.talk_time(s.assign_speakers(x, t).join(x.drop("speaker"), ["recording_id", "seg_id"]).filter("carried is not null"), "carried")),
    "gap_speakers": _segs(s.gap_speakers),
    "turn_overlap_flags": _turns(s.overlap_flags),
    "min_speaker_share": _turns(s.min_speaker_share),
    "hallucination_filter": _segs_words(s.hallucinations),
    "output_rows": _segs(lambda x: s.output_rows(x.withColumn("text_pl", F.when(F.col("seg_id") % 3 == 0, "").when(F.col("seg_id") % 3 == 1, F.concat(F.lit("pl "), "text"))))),
    "retranscribe_range": _segs(lambda x: s.replace_range(x, _fragment(x), 20_000, 40_000)),
    "splice_midpoint": _segs(lambda x: s.replace_range(x, _fragment(x), 20_000, 40_000, midpoint=True)),
    "reassign_by_overlap": _segs_turns(s.reassign_by_overlap),
    "speakers_overlap": _segs(s.speakers_overlap),
    "asof_active_segment": _segs_turns(lambda x, t: s.active_at(x, _points(t))),
    "nearest_segment": _segs_turns(lambda x, t: s.nearest_to(x, _points(t))),
    "segment_context": _segs(s.context),
    "timeline_geometry": _segs(s.timeline),
    "speaker_lists": _segs(s.speaker_lists),
    "turn_word_filter": lambda spark, d: (lambda conv, x: s.turn_words(x, c.words(x), c.turns(x, conv)))(*_base(spark, d)),
    "display_names": _segs(lambda x: s.display_names(_named(x))),
    "recent_transcript": _segs(s.recent_transcript),
    "split_at_turns": _segs_turns(s.split_at_turns),
}


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([c.VIEWS_SQL, *ctes]) + "\n" + body


_CONF = "conf AS (SELECT recording_id, seg_id, count(*) AS n_words, CAST(sum(prob_pct) AS BIGINT) AS prob_sum, (20 * sum(prob_pct) + count(*)) // (2 * count(*)) / 1000.0 AS confidence FROM words GROUP BY recording_id, seg_id)"
_ISLANDS = """islands AS (
  SELECT recording_id, island, arg_min(speaker, seg_id) AS speaker, arg_min(start_ms, seg_id) AS start_ms, arg_max(end_ms, seg_id) AS end_ms, string_agg(text, ' ' ORDER BY seg_id) AS text, count(*) AS n_segments
  FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY recording_id ORDER BY seg_id) - 1 AS INT) AS island FROM (
    SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start_ms - lag(end_ms) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id)))
  GROUP BY ALL)"""
_TAGS = r"""tagged AS (
  SELECT recording_id, seg_id, list_filter([
    CASE WHEN trim(regexp_replace(lower(shown), '[^\p{L}\p{N}_\s]', '', 'g')) IN (""" + ", ".join(f"'{x}'" for x in s.INTERJECTIONS) + r""") THEN 'interjection' END,
    CASE WHEN trim(regexp_replace(lower(shown), '[^\p{L}\p{N}_\s]', '', 'g')) IN (""" + ", ".join(f"'{x}'" for x in s.INTERJECTIONS) + r""") AND lag(speaker) OVER w = lead(speaker) OVER w AND lag(speaker) OVER w <> speaker THEN 'check-speaker' END,
    CASE WHEN shown LIKE '%?' THEN 'question' END, CASE WHEN prob_sum < 55 * n_words THEN 'low-conf' END,
    CASE WHEN end_ms - start_ms > 20000 THEN 'long' END, CASE WHEN start_ms - lag(end_ms) OVER w > 3000 THEN 'silence-gap' END, CASE WHEN ipa THEN 'ipa' END], lambda x: x IS NOT NULL) AS tags
  FROM (SELECT *, trim(CASE WHEN seg_id % 10 = 5 THEN 'Mhm!' WHEN seg_id % 5 = 0 THEN text || '?' ELSE text END) AS shown FROM segments) LEFT JOIN conf USING (recording_id, seg_id)
    LEFT JOIN (SELECT DISTINCT recording_id, seg_id, true AS ipa FROM words WHERE prob_pct > 97) USING (recording_id, seg_id) WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id))"""
_OVER = """over_ AS (
  SELECT s.recording_id, s.seg_id, t.turn_idx, t.speaker_raw, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS overlap_ms
  FROM segments s JOIN turns t USING (recording_id) WHERE least(s.end_ms, t.end_ms) > greatest(s.start_ms, t.start_ms))"""
_ASSIGN = """assign_ AS (
  SELECT recording_id, seg_id, start_ms, end_ms, assigned, coalesce(last_value(assigned IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seg_id), first_value(assigned IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'GŁOS_01') AS carried
  FROM (SELECT s.recording_id, s.seg_id, s.start_ms, s.end_ms, CASE WHEN ms * 100 >= (end_ms - start_ms) * CASE WHEN end_ms - start_ms < 500 THEN 1 ELSE 5 END THEN speaker_raw END AS assigned
    FROM segments s LEFT JOIN (SELECT * FROM (SELECT recording_id, seg_id, speaker_raw, sum(overlap_ms) AS ms, row_number() OVER (PARTITION BY recording_id, seg_id ORDER BY sum(overlap_ms) DESC, min(turn_idx)) AS r FROM over_ GROUP BY recording_id, seg_id, speaker_raw) WHERE r = 1) b USING (recording_id, seg_id)))"""


def _talk(src: str, speaker: str, order: str) -> str:
    return f"""SELECT recording_id, speaker, talk_ms, round(talk_ms / greatest(sum(talk_ms) OVER (PARTITION BY recording_id), 1000), 6) AS share, CAST(r AS INT) AS rank, printf('GŁOS_%02d', r) AS label
FROM (SELECT recording_id, {speaker} AS speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, row_number() OVER (PARTITION BY recording_id ORDER BY sum(end_ms - start_ms) DESC, min({order})) AS r FROM {src} GROUP BY recording_id, {speaker})"""


def _replaced(at: str) -> str:
    return f"""SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, n, seg_id) - 1 AS INT) AS new_id, speaker, text, start_ms, end_ms FROM (
  SELECT recording_id, seg_id, speaker, text, start_ms, end_ms, 0 AS n FROM segments WHERE {at} < 20000 OR {at} >= 40000
  UNION ALL SELECT recording_id, seg_id, speaker, 'again ' || text, start_ms + 5, end_ms + 5, 1 FROM segments WHERE start_ms >= 20000 AND start_ms < 40000)"""


_POINTS = "points AS (SELECT DISTINCT recording_id, start_ms + 700 AS t_ms FROM turns)"

ORACLES = {
    "segments_view": _sql("SELECT * FROM segments"),
    "turns_view": _sql("SELECT * FROM turns"),
    "seg_merge_islands": _sql("SELECT * FROM islands", _ISLANDS),
    "speaker_talk_share": _sql(_talk("islands", "speaker", "island"), _ISLANDS),
    "segment_confidence": _sql("SELECT *, CASE WHEN confidence < 0.5 THEN 'red' WHEN confidence < 0.7 THEN 'amber' END AS bucket FROM conf", _CONF),
    "quality_report": _sql(
        """SELECT recording_id, n_segments, low_confidence, very_short, repetitions, long_gaps, mean AS avg_confidence,
  concat_ws(',', CASE WHEN mean < 0.65 THEN 'low_average' END, CASE WHEN low_confidence > 0.2 * n_segments THEN 'many_low' END, CASE WHEN repetitions > 3 THEN 'repetitions' END, CASE WHEN long_gaps > 0 THEN 'gaps' END) AS warnings,
  mean < 0.6 OR repetitions > 5 AS retranscribe
FROM (SELECT recording_id, count(*) AS n_segments, count(*) FILTER (prob_sum < 55 * n_words) AS low_confidence, count(*) FILTER (end_ms - start_ms < 400) AS very_short, count(*) FILTER (same = prev AND same <> '') AS repetitions,
  count(*) FILTER (gap > 10000) AS long_gaps, CASE WHEN coalesce(sum(n_words), 0) > 0 THEN (20 * sum(prob_sum) + sum(n_words))::BIGINT // (2 * sum(n_words))::BIGINT / 1000.0::DOUBLE ELSE 1.0 END::DOUBLE AS mean
  FROM (SELECT s.*, n_words, prob_sum, lower(trim(text)) AS same, lag(lower(trim(text))) OVER w AS prev, start_ms - lag(end_ms) OVER w AS gap FROM segments s LEFT JOIN conf USING (recording_id, seg_id) WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id)) GROUP BY ALL)""",
        _CONF,
    ),
    "segment_tags": _sql("SELECT recording_id, seg_id, array_to_string(tags, ',') AS tags FROM tagged", _CONF, _TAGS),
    "tag_summary": _sql("SELECT tag, count(*) AS n, count(DISTINCT recording_id) AS n_recordings FROM (SELECT recording_id, unnest(tags) AS tag FROM tagged) GROUP BY tag", _CONF, _TAGS),
    "seg_overlap_pairs": _sql("SELECT * FROM over_", _OVER),
    "seg_overlap_assign": _sql("SELECT recording_id, seg_id, assigned, carried FROM assign_", _OVER, _ASSIGN),
    "speaker_renumber": _sql(_talk("assign_ WHERE carried IS NOT NULL", "carried", "seg_id"), _OVER, _ASSIGN),
    "gap_speakers": _sql("SELECT recording_id, seg_id, CAST(sum(ch) OVER (PARTITION BY recording_id ORDER BY seg_id) % 6 AS INT) AS speaker_no FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY recording_id ORDER BY seg_id) >= 1500 THEN 1 ELSE 0 END AS ch FROM segments)"),
    "turn_overlap_flags": _sql("SELECT recording_id, turn_idx, coalesce(start_ms < e, false) AS overlapping, CASE WHEN start_ms < e THEN w_ END AS overlap_with, CASE WHEN start_ms < e THEN round((e - start_ms) / 1000.0, 3) END AS overlap_sec FROM (SELECT *, lag(end_ms) OVER w AS e, lag(label) OVER w AS w_ FROM turns JOIN (SELECT recording_id, speaker_raw, printf('GŁOS_%02d', row_number() OVER (PARTITION BY recording_id ORDER BY ms DESC, s0, t0)) AS label FROM (SELECT recording_id, speaker_raw, sum(end_ms - start_ms) AS ms, min(start_ms) AS s0, arg_min(turn_idx, start_ms * 100000 + turn_idx) AS t0 FROM turns GROUP BY ALL)) USING (recording_id, speaker_raw) WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, turn_idx))"),
    "min_speaker_share": _sql("SELECT recording_id, round(coalesce(min(ms) / nullif(sum(ms), 0), 0), 6) AS min_share FROM (SELECT recording_id, speaker_raw, sum(end_ms - start_ms) AS ms FROM turns GROUP BY ALL) GROUP BY ALL"),
    "hallucination_filter": _sql("SELECT * FROM (SELECT recording_id, seg_id, CASE WHEN coalesce(n_words, 0) * 1000 > 12 * greatest(end_ms - start_ms, 50) AND end_ms - start_ms < 1000 THEN 'too_fast' WHEN prob_sum < 12 * n_words AND end_ms - start_ms < 2000 THEN 'unsure' WHEN prob_sum < 30 * n_words AND end_ms - start_ms < 1500 THEN 'low_confidence' END AS reason FROM segments LEFT JOIN conf USING (recording_id, seg_id)) WHERE reason IS NOT NULL", _CONF),
    "output_rows": _sql("SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_id) - 1 AS INT) AS new_id, seg_id, speaker, text, CASE WHEN seg_id % 3 = 1 THEN 'pl ' || text ELSE text END AS text_pl FROM segments WHERE trim(text) <> ''"),
    "retranscribe_range": _sql(_replaced("start_ms")),
    "splice_midpoint": _sql(_replaced("((start_ms + end_ms) / 2)")),
    "reassign_by_overlap": _sql("SELECT recording_id, seg_id, coalesce(f, speaker) AS speaker FROM segments LEFT JOIN (SELECT recording_id, seg_id, speaker_raw AS f FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_id ORDER BY overlap_ms DESC, turn_idx) AS r FROM over_) WHERE r = 1) USING (recording_id, seg_id)", _OVER),
    "speakers_overlap": _sql("SELECT DISTINCT recording_id, a.speaker AS a, b.speaker AS b FROM segments a JOIN segments b USING (recording_id) WHERE a.speaker < b.speaker AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 200"),
    "asof_active_segment": _sql("SELECT recording_id, t_ms, (SELECT max_by(seg_id, (start_ms, seg_id)) FROM segments s WHERE s.recording_id = p.recording_id AND start_ms <= t_ms) AS seg_id FROM points p", _POINTS),
    "nearest_segment": _sql("SELECT recording_id, t_ms, seg_id FROM (SELECT p.recording_id, t_ms, seg_id, row_number() OVER (PARTITION BY p.recording_id, t_ms ORDER BY abs(start_ms - t_ms), seg_id) AS r FROM points p JOIN segments s USING (recording_id)) WHERE r = 1", _POINTS),
    "segment_context": _sql("SELECT recording_id, seg_id, CAST(len(l) AS INT) AS n_context, array_to_string(l, ' ') AS context FROM (SELECT *, list(text) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM segments)"),
    "timeline_geometry": _sql("SELECT recording_id, seg_id, round(start_ms * 100 / w, 4) AS left_pct, round(greatest((end_ms - start_ms) * 100 / w, 0.3), 4) AS width_pct FROM (SELECT *, greatest(max(end_ms) OVER (PARTITION BY recording_id), 1) AS w FROM segments)"),
    "speaker_lists": _sql("SELECT recording_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, arg_max(end_ms, seg_id) AS duration_ms FROM segments GROUP BY ALL"),
    "turn_word_filter": _sql("SELECT recording_id, turn_idx, count(*) AS n_words, string_agg(word, ' ' ORDER BY seg_id, word_idx) AS text FROM (SELECT w.*, CAST(s.turn AS INT) AS turn_idx, s.start_ms + ((s.end_ms - s.start_ms) * word_idx) // count(*) OVER (PARTITION BY w.recording_id, w.seg_id) AS at_ FROM words w JOIN segments s USING (recording_id, seg_id)) x JOIN turns t USING (recording_id, turn_idx) WHERE at_ >= t.start_ms - 30 AND at_ < t.end_ms + 30 GROUP BY ALL"),
    "display_names": _sql("SELECT recording_id, speaker, CASE WHEN name IS NULL THEN kind || '_' || row_number() OVER (PARTITION BY recording_id, name IS NULL, kind ORDER BY speaker) ELSE name END AS display FROM (SELECT DISTINCT recording_id, speaker, CASE WHEN recording_id % 3 = 0 AND speaker = 'user' THEN 'Ada' END AS name, CASE speaker WHEN 'assistant' THEN 'Kobieta' WHEN 'user' THEN 'Mężczyzna' ELSE 'Osoba' END AS kind FROM segments)"),
    "recent_transcript": _sql("SELECT recording_id, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY seg_id) AS transcript FROM (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, speaker || ': ' || text AS line, row_number() OVER (PARTITION BY recording_id ORDER BY seg_id DESC) AS back FROM segments) WHERE back <= 40) WHERE before <= 5000 GROUP BY ALL"),
    "split_at_turns": _sql(
        """SELECT recording_id, seg_id, CAST(i AS INT) AS piece, edges[i + 1] AS start_ms, edges[i + 2] AS end_ms FROM (SELECT *, unnest(range(len(edges) - 1)) AS i FROM (
  SELECT s.recording_id, s.seg_id, list_concat([s.start_ms], coalesce(list_sort(list(DISTINCT cut) FILTER (cut IS NOT NULL)), []), [s.end_ms]) AS edges
  FROM segments s LEFT JOIN cuts k ON s.recording_id = k.recording_id AND cut > s.start_ms AND cut < s.end_ms GROUP BY s.recording_id, s.seg_id, s.start_ms, s.end_ms)) WHERE edges[i + 2] - edges[i + 1] >= 100""",
        "cuts AS (SELECT recording_id, (end_ms + lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, turn_idx)) // 2 AS cut FROM turns)",
    ),
}
