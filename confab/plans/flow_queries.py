"""Queries over profiles and composite operators and their DuckDB oracles."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.operators import asr, flows, profiles, signal, translation, voices
from confab.operators import models as m
from confab.operators import retrieval as r
from confab.operators import segments as s
from confab.operators import text as x
from confab.plans.segment_queries import _base, _segs, _segs_turns, _segs_words, _sql
from confab.plans.text_queries import _ASKED, _BATCH, _CHUNKS, _DT, _KW, _docs, _queries, in_recordings
from confab.sources import conversations as c


def _chat(spark, d):
    docs, asked = _docs(_base(spark, d)[1]), _queries(spark)
    more = asked.unionByName(spark.range(1).select(F.lit(9).alias("query_id"), F.lit("zzz").alias("query")))
    hits = r.top_k(r.keyword_scores(docs, asked), 6)
    return flows.chat_context(hits, docs, more.select("query_id", F.col("query").alias("text")))


def _fragments(spark, d):
    """Of each recording's 20 voices the first 8 are known, the others are a fragment's."""
    v, nth = in_recordings(c.table(spark, d, "embeddings")), F.col("vec_id") % 20
    known = v.filter(nth < 8).select("recording_id", F.format_string("GŁOS_%02d", nth + 1).alias("label"), F.col("embedding").alias("vector"))
    heard = v.filter(nth >= 8).select("recording_id", F.concat(F.lit("raw"), F.col("vec_id").cast("string")).alias("raw"), F.col("embedding").alias("vector"), (-F.col("vec_id")).alias("first"))
    return profiles.remapped_fragment(heard, known, 0.3)


def _summaries(segs):
    def model(prompts):
        return prompts.select("recording_id", "part", F.concat(F.lit("S "), F.substring("prompt", 1, 40), F.lit("\nline\nmore\nunused")).alias("reply"))

    return flows.summarised(segs, model)


def _cutoff(segs):
    """Chunks of 30 s that begin 4 s before the last one's end hear every segment that starts in them."""
    chunks = signal.overlapping_chunks(segs.groupBy("recording_id").agg(F.max("end_ms").alias("n")), 30_000, 4_000).select("recording_id", "chunk", F.col("start").alias("start_ms"), F.col("end").alias("_end"))
    heard = segs.select("recording_id", "seg_id", "start_ms").join(chunks.withColumnRenamed("start_ms", "_at"), "recording_id").filter("start_ms >= _at and start_ms < _end")
    return asr.without_overlap(heard.select("recording_id", "chunk", "seg_id", "start_ms"), chunks, 4_000)


def _merges(segs):
    return m.guarded_merges(_pairs(segs))


def _pairs(segs):
    pairs = segs.select("recording_id", "speaker").distinct()
    a, b = pairs.withColumnRenamed("speaker", "a"), pairs.withColumnRenamed("speaker", "b")
    score = F.round(0.985 + ((F.col("recording_id") * 7 + F.length("a") * 3 + F.length("b")) % 13) / 1000.0, 4)
    rows = a.join(b, "recording_id").filter("a < b").withColumns({"cosine": score, "conflict": F.col("recording_id") % 11 == 0, "overlap": F.lit(False), "talk_a": F.length("a"), "talk_b": F.length("b")})
    return rows


def _half_translated(segs):
    """Two of three rows are translated, two of five translations are scored 2 or less."""
    return segs.withColumns({"score": F.col("seg_id") % 5 + 1, "text_pl": F.when(F.col("seg_id") % 3 == 0, "").otherwise(F.concat(F.lit("PL "), "text"))})


def _meetings(segs):
    """Fifty conversations in a row as one recording."""
    nth = F.row_number().over(Window.partitionBy("_m").orderBy("recording_id", "seg_id")) - 1
    rows = segs.withColumn("_m", F.expr("recording_id div 50")).withColumn("_n", nth.cast("int"))
    return rows.drop("recording_id", "seg_id").withColumnsRenamed({"_m": "recording_id", "_n": "seg_id"})


def _scored(prompts):
    """Scores by the length of what is shown: 1 of an even one, else 5; the average with them."""
    out = []
    for p in prompts:
        marks = [5 if len(line) % 2 else 1 for line in p.split("\n") if line.startswith("   [pl] ")]
        out.append(json.dumps({"scores": marks, "avg": sum(marks) / len(marks)}))
    return out


def _asked_again(prompts):
    """The digest of what was asked, but for short ones nothing at all."""
    return ["" if len(p) % 5 == 0 else " " + hashlib.md5(p.encode()).hexdigest() + " " for p in prompts]


def _in_a_row(segs):
    """Segments one after the other, without gaps or overlaps."""
    length = F.col("end_ms") - F.col("start_ms")
    rows = segs.withColumns({"end_ms": F.sum(length).over(s.by_id().rowsBetween(Window.unboundedPreceding, 0)), "_d": length})
    return rows.withColumn("start_ms", F.col("end_ms") - F.col("_d")).drop("_d")


def _voices(op):
    """Sound of 1,000 samples a second made of the texts: each letter is a tone of 60 ms."""

    def run(segs):
        rows = _in_a_row(segs)
        tones = F.array(*[F.array(*[F.lit(math.sin(i * (0.2 + letter / 13))).cast("float") for i in range(60)]) for letter in range(32)])
        sound = lambda text: F.flatten(F.transform(F.split(text, ""), lambda ch: F.get(tones, F.ascii(ch) % 32)))
        n = F.least(60 * F.size(F.split("text", "")), F.col("end_ms") - F.col("start_ms"))
        return op(rows, rows.select("recording_id", F.col("start_ms").alias("start"), n.alias("n"), F.col("text").alias("source")), rate=1000, sound=sound)

    return run


def _probed(segs):
    """Speakers counted in probes; a meeting's rows are its turns."""
    rows = _in_a_row(_meetings(segs))
    probes = asr.count_probes(rows.groupBy("recording_id").agg((F.max("end_ms") / 1000).alias("duration")))
    return asr.probed_counts(rows.withColumnRenamed("speaker", "speaker_raw"), probes)


def _context_lines(segs, words):
    rows = _meetings(segs).withColumn("text_pl", F.when(F.col("seg_id") % 4 == 1, F.concat(F.lit(" PL "), "text")))
    names = rows.select("recording_id", "speaker").distinct().withColumn("name", F.when(F.col("speaker") == "user", "Ada"))
    tags = rows.filter(F.col("text").contains("a")).select("recording_id", "seg_id", F.array_sort(F.filter(F.array(F.when(F.col("text").contains("e"), "e"), F.when(F.length("text") > 80, "long")), lambda t: t.isNotNull())).alias("tags"))
    return s.context_lines(rows, names, tags, 30)


def _checked(segs, report):
    rows = _meetings(segs)
    rows = rows.join(x.translation_batches(rows), ["recording_id", "seg_id"]).withColumn("text_pl", F.concat(F.lit("PL "), "text"))
    return translation.checked_translation(rows.select("recording_id", "seg_id", "batch_id", "text", "text_pl"), "en", _scored, _asked_again)[report]


def _twice(segs):
    """The second hearing doubles the first word or hears something else; confidences by position."""
    key = F.col("recording_id") * 1000 + F.col("seg_id")
    return segs.select(key.alias("key"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), F.col("text").alias("a_text"), ((key * 7) % 100 / 100.0).alias("a_conf"), F.when(key % 2 == 0, F.lit("quite other words")).otherwise(F.col("text")).alias("b_text"), ((key * 13) % 100 / 100.0).alias("b_conf"), F.concat("text", F.lit(" again")).alias("c_text"), ((key * 31) % 100 / 100.0).alias("c_conf"))


def _profiles(segs):
    base = segs.groupBy("recording_id", "speaker").agg(F.count(F.lit(1)).alias("n_segments"))
    names = s.display_names(base.select("recording_id", "speaker", F.lit(None).cast("string").alias("name"), F.lit("zenski").alias("gender"))).filter("speaker <> 'system'")
    features = segs.filter("end_ms - start_ms > 9000").groupBy("recording_id", "speaker").agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    return profiles.profiles(base, names, features).withColumn("longest_ms", F.coalesce("longest_ms", F.lit(0)))


def _timed_words(segs):
    """Words spread evenly over their segment."""
    n, span = F.count(F.lit(1)).over(Window.partitionBy("recording_id", "seg_id")), F.col("end_ms") - F.col("start_ms")
    rows = c.words(segs).join(segs.select("recording_id", "seg_id", "start_ms", "end_ms"), ["recording_id", "seg_id"])
    return rows.select("recording_id", "seg_id", "word_idx", "word", (F.col("start_ms") + F.floor(F.col("word_idx") * span / n)).alias("start_ms"))


QUERIES = {
    "diarization_plan": _segs_turns(lambda x, t: flows.diarized_whole(x, t, _timed_words(x))),
    "event_routing": lambda spark, d: flows.routed(c.table(spark, d, "events"), terminal=("purchase",)),
    "allowed_parameters": lambda spark, d: flows.allowed_parameters(c.table(spark, d, "events").select(F.col("event_id").alias("recording_id"), F.create_map(F.lit("temperature"), F.col("event_type"), F.lit("beam_size"), F.when(F.col("event_id") % 2 == 0, "5"), F.lit("secret"), F.lit("x")).alias("params"))).select("recording_id", F.explode("params").alias("name", "value")),
    "age_profiles": lambda spark, d: c.table(spark, d, "customer").select("c_custkey", signal.pitch_profile(F.when(F.col("c_custkey") % 9 != 0, 60 + F.col("c_custkey") % 300)).alias("p"), signal.calibrated_age(F.col("c_custkey") % 90).alias("model_age")).select("c_custkey", "p.gender", F.round("p.age", 6).alias("age"), "p.age_group", F.col("model_age").cast("long").alias("model_age")),
    "emotion_argmax": lambda spark, d: c.table(spark, d, "events").select("event_id", profiles.argmax(F.create_map(F.lit("joy"), F.col("event_id") % 7, F.lit("anger"), F.col("event_id") % 5, F.lit("calm"), F.col("event_id") % 3)).alias("emotion")),
    "index_entries": _segs(lambda s: flows.index_entries(s).withColumn("segment_ids", F.array_join(F.col("segment_ids").cast("array<string>"), ","))),
    "chat_context": _chat,
    "fragment_remap": _fragments,
    "map_reduce_summary": _segs(_summaries),
    "ambiguous_segments": _segs(lambda s: m.ambiguous(s, 800, 2, 30)),
    "guarded_merges": _segs(_merges),
    "diarize_pipeline": _segs_turns(lambda s, t: flows.diarized(s, t).select("recording_id", "seg_id", "speaker")),
    "refine_pipeline": _segs(lambda s: flows.refined(s).select("recording_id", "seg_id", "speaker")),
    "speaker_counts": _segs_turns(lambda x, t: asr.speaker_counts(t.withColumn("probe", F.col("turn_idx") % 2))),
    "chunk_overlap_cutoff": _segs(_cutoff),
    "chosen_run": _segs_turns(lambda x, t: asr.chosen_run(t.withColumn("run", F.lit(0)).unionByName(t.filter("turn_idx % 3 < 2").withColumn("run", F.lit(1))), 0.3)),
    "recogniser_prompts": _segs(asr.prompts),
    "merged_speakers": _segs(lambda x: asr.merged_speakers(x, _pairs(x))),
    "energy_speakers": _segs(lambda x: s.energy_speakers(x.withColumn("energy", (F.col("seg_id") * 37 % 11).cast("double")))),
    "quote_lines": _segs(s.quote_lines),
    "retranslate_context": _segs(lambda x: m.retry_contexts(_half_translated(x))),
    "retranslated_rows": _segs(lambda x: m.applied_retries(_half_translated(x), _half_translated(x).filter("score <= 2").select("recording_id", "seg_id", F.expr("CASE seg_id % 3 WHEN 0 THEN ' ' || lower(text) || ' ' WHEN 1 THEN ' ' ELSE ' anew ' || text || ' ' END").alias("retry"))).select("recording_id", "seg_id", "text_pl")),
    "checked_translation": _segs(lambda x: _checked(x, 0)),
    "translation_report": _segs(lambda x: _checked(x, 1)),
    "probed_counts": _segs(_probed),
    "voice_pairs": _segs(_voices(voices.voice_pairs)),
    "merged_voices": _segs(_voices(voices.merged_voices)),
    "context_lines": _segs_words(_context_lines),
    "translated_counts": _segs(lambda x: s.translated_counts(_half_translated(x).withColumn("text_pl", F.when(F.col("seg_id") % 3 == 1, F.col("text")).otherwise(F.col("text_pl"))))),
    "unsure_words": _segs(lambda x: s.unsure_words(c.words(x))),
    "multi_pass_choice": _segs(lambda x: m.multi_pass(_twice(x))),
    "best_candidate": lambda spark, d: m.better_candidate(c.table(spark, d, "events").select("user_id", "event_id", F.round("value", 1).alias("confidence"), (F.col("event_id") * -1).alias("preferred")), ["user_id"]).select("user_id", "event_id", "confidence"),
    "speaker_profiles": _segs(_profiles),
    "probe_summary": lambda spark, d: m.probe_summary(c.table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("pos"), ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.col("event_type").alias("language"))),
    "probe_positions": _segs(lambda s: m.probe_positions(s.groupBy("recording_id").agg((F.max("end_ms") / 1000.0).alias("duration"))).select("recording_id", F.round("at", 4).alias("at"), "length")),
}

_REMAP = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"

_MEET = "meet AS (SELECT recording_id // 50 AS recording_id, CAST(row_number() OVER (PARTITION BY recording_id // 50 ORDER BY recording_id, seg_id) - 1 AS INT) AS seg_id, speaker, text, start_ms, end_ms FROM segments)"
_WALK = """marked AS (SELECT *, CASE WHEN least(120, length(text) + 3) % 2 = 0 THEN 1 ELSE 5 END AS mark, batch_id % 2 = 1 AND row_number() OVER (PARTITION BY recording_id, batch_id ORDER BY seg_id) <= 4 AS seen FROM meet JOIN batched USING (recording_id, seg_id)),
r AS (SELECT recording_id, seg_id, text, seen AND mark = 1 AS low, 'PL ' || lead(text) OVER (PARTITION BY recording_id ORDER BY seg_id) AS after FROM marked),
walk AS (
  SELECT DISTINCT recording_id, -1 AS seg_id, NULL::VARCHAR AS prev, NULL::VARCHAR AS now, false AS again FROM meet
  UNION ALL
  SELECT recording_id, seg_id, prev, CASE WHEN low AND length(p) % 5 <> 0 THEN md5(p) ELSE 'PL ' || text END, low AND length(p) % 5 <> 0 FROM (
    SELECT r.*, w.now AS prev, 'Translate from en into natural Polish; answer with the translation only.' || chr(10) || CASE WHEN concat_ws(' / ', w.prev, w.now) <> '' THEN 'Before: ' || concat_ws(' / ', w.prev, w.now) || chr(10) ELSE '' END || 'TRANSLATE: ' || r.text || coalesce(chr(10) || 'After: ' || r.after, '') AS p
    FROM walk w JOIN r ON r.recording_id = w.recording_id AND r.seg_id = w.seg_id + 1))"""
_WALKED = (_MEET, _BATCH.replace("FROM segments)", "FROM meet)"), _WALK)

ORACLES = {
    "checked_translation": _sql("SELECT recording_id, seg_id, now AS text_pl FROM walk WHERE seg_id >= 0", *_WALKED).replace("WITH ", "WITH RECURSIVE ", 1),
    "translation_report": _sql("SELECT recording_id, n_translated, coalesce(n_checks, 0) AS n_checks, average, n_retranslated, coalesce(average >= 3, true) AS acceptable FROM (SELECT recording_id, count(*) AS n_translated, count(*) FILTER (again) AS n_retranslated FROM walk WHERE seg_id >= 0 GROUP BY ALL) LEFT JOIN (SELECT recording_id, count(*) AS n_checks, round_even(avg(a), 2) AS average FROM (SELECT recording_id, batch_id, avg(mark) AS a FROM marked WHERE seen GROUP BY ALL) GROUP BY ALL) USING (recording_id)", *_WALKED).replace("WITH ", "WITH RECURSIVE ", 1),
    "probed_counts": _sql("""SELECT recording_id, count(*) AS n_probes, max(n) AS n_speakers FROM (
  SELECT p.recording_id, i, greatest(1, count(DISTINCT speaker)) AS n FROM (
    SELECT recording_id, i, CAST(round(CASE WHEN d <= 900 THEN 0 ELSE greatest(0, least(d * i / m, d - 120)) END * 1000) AS BIGINT) AS s, CAST(round(CASE WHEN d <= 900 THEN d ELSE least(greatest(0, least(d * i / m, d - 120)) + 120, d) END * 1000) AS BIGINT) AS e
    FROM (SELECT *, CASE WHEN d <= 900 THEN 1 ELSE greatest(4, CAST(floor(d / 120) AS INT)) END AS m FROM (SELECT recording_id, max(till) / 1000.0::DOUBLE AS d FROM said GROUP BY ALL)) JOIN range(0, 100000) g(i) ON i < m) p
  LEFT JOIN said t ON t.recording_id = p.recording_id AND t.till - t.ms < p.e AND t.till > p.s GROUP BY ALL) GROUP BY recording_id""", _MEET, "said AS (SELECT recording_id, speaker, CAST(end_ms - start_ms AS BIGINT) AS ms, CAST(sum(end_ms - start_ms) OVER (PARTITION BY recording_id ORDER BY seg_id) AS BIGINT) AS till FROM meet)"),
    "context_lines": _sql("SELECT recording_id, count(*) AS n_rows, string_agg('[' || (start_ms // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || ' ' || CASE speaker WHEN 'user' THEN 'Ada' ELSE speaker END || ']' || CASE WHEN contains(text, 'a') THEN ' [' || concat_ws(', ', CASE WHEN contains(text, 'e') THEN 'e' END, CASE WHEN length(text) > 80 THEN 'long' END) || ']' ELSE '' END || ' ' || CASE WHEN seg_id % 4 = 1 THEN 'PL ' || text ELSE text END, chr(10) ORDER BY seg_id) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_id DESC) AS back FROM meet) WHERE back <= 30 GROUP BY ALL", _MEET),
    "translated_counts": _sql("SELECT recording_id, count(*) FILTER (seg_id % 3 = 2) AS n_translated FROM segments GROUP BY ALL"),
    "event_routing": "SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS last_kind, bool_or(e IS NOT NULL) AS ended, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS e FROM events) WHERE e IS NULL OR event_id <= e GROUP BY user_id",
    "allowed_parameters": "SELECT event_id AS recording_id, 'temperature' AS name, event_type AS value FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_id, 'beam_size', '5' FROM events WHERE event_id % 2 = 0",
    "age_profiles": """SELECT c_custkey, gender, round(age, 6) AS age, CASE WHEN age IS NULL THEN 'nieznany' WHEN gender = 'dziecko' OR age < 18 THEN 'dziecko' WHEN age < 30 THEN 'mlody' WHEN age < 55 THEN 'dorosly' ELSE 'starszy' END AS age_group,
  CASE WHEN c_custkey % 90 < 35 THEN greatest(5, c_custkey % 90 - 8) WHEN c_custkey % 90 < 55 THEN greatest(18, c_custkey % 90 - 10) ELSE greatest(18, c_custkey % 90 - 12) END AS model_age
FROM (SELECT c_custkey, CASE WHEN f > 250 THEN 'dziecko' WHEN f >= 165 THEN 'zenski' WHEN f IS NOT NULL THEN 'meski' END AS gender,
  CASE WHEN f > 250 THEN least(greatest(300 - 0.5::DOUBLE * f, 5), 17) WHEN f >= 165 THEN least(greatest(300 - 0.8::DOUBLE * f, 18), 80) WHEN f IS NOT NULL THEN least(greatest(220 - 0.7::DOUBLE * f, 18), 80) END::DOUBLE AS age FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN 60 + c_custkey % 300 END AS f FROM customer))""",
    "emotion_argmax": "SELECT event_id, CASE WHEN event_id % 5 >= event_id % 7 AND event_id % 5 >= event_id % 3 THEN 'anger' WHEN event_id % 3 >= event_id % 7 THEN 'calm' ELSE 'joy' END AS emotion FROM events",
    "chat_context": _sql(
        "SELECT q.query_id, coalesce(l, substr(query, 1, 3000)) AS context FROM (SELECT * FROM asked UNION ALL SELECT 9, 'zzz') q LEFT JOIN (SELECT query_id, string_agg('[' || r || '] ' || text, chr(10) || chr(10) ORDER BY r) AS l FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM kw) k JOIN segments s ON s.recording_id * 1000 + s.seg_id = k.doc_id WHERE r <= 6 GROUP BY query_id) h USING (query_id)",
        _ASKED, _DT, _KW,
    ),
    "fragment_remap": f"""WITH heard AS (SELECT * FROM embeddings WHERE vec_id % 20 >= 8), known AS (SELECT * FROM embeddings WHERE vec_id % 20 < 8), best AS (SELECT vec_id // 20 AS recording_id, 'raw' || vec_id AS raw, found, s FROM (
    SELECT a.vec_id, printf('GŁOS_%02d', b.vec_id % 20 + 1) AS found, round({_REMAP}, 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_REMAP}, 6) DESC, b.vec_id) AS r FROM heard a LEFT JOIN known b ON a.vec_id // 20 = b.vec_id // 20) WHERE r = 1),
  tops AS (SELECT vec_id // 20 AS recording_id, max(vec_id % 20 + 1) AS top FROM known GROUP BY 1)
SELECT recording_id, raw, CASE WHEN s >= 0.3 THEN found ELSE printf('GŁOS_%02d', coalesce(top, 0) + row_number() OVER (PARTITION BY recording_id, coalesce(s >= 0.3, false) ORDER BY CAST(raw[4:] AS BIGINT) DESC)) END AS label FROM best LEFT JOIN tops USING (recording_id)""",
    "index_entries": _sql("SELECT c.recording_id, CAST(chunk_id AS INT) AS chunk_id, string_agg(text, ' ' ORDER BY s.seg_id) AS text, string_agg(CAST(s.seg_id AS VARCHAR), ',' ORDER BY s.seg_id) AS segment_ids FROM chunks_ c JOIN segments s ON s.recording_id = c.recording_id AND s.seg_id BETWEEN first_idx AND last_idx WHERE chunk_id < 300 GROUP BY c.recording_id, chunk_id", _CHUNKS).replace("WITH ", "WITH RECURSIVE ", 1),
    "map_reduce_summary": _sql("SELECT recording_id, substr('S ' || substr(CASE WHEN ms <= 1800000 OR length(t) <= 6000 THEN t ELSE 'S ' || substr(t, 1, 40) || chr(10) || 'line' || chr(10) || 'more' END, 1, 40), 1, 300) || ' line more' AS summary FROM (SELECT recording_id, max(end_ms) AS ms, string_agg(text, ' ' ORDER BY seg_id) AS t FROM segments GROUP BY ALL)"),
    "ambiguous_segments": _sql("SELECT recording_id, seg_id, context FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM (SELECT *, array_to_string(list(speaker || ': ' || text) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM segments) WHERE end_ms - start_ms < 800 AND trim(text) <> '') WHERE n <= 30"),
    "guarded_merges": _sql("""SELECT recording_id, removed, arg_max(kept, a || '|' || b) AS kept FROM (SELECT recording_id, a, b, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS removed, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS kept, cosine, min(cosine) OVER (PARTITION BY recording_id) AS low
  FROM (SELECT x.recording_id, x.speaker AS a, y.speaker AS b, round(0.985::DOUBLE + ((x.recording_id * 7 + length(x.speaker) * 3 + length(y.speaker)) % 13) / 1000.0::DOUBLE, 4) AS cosine FROM (SELECT DISTINCT recording_id, speaker FROM segments) x JOIN (SELECT DISTINCT recording_id, speaker FROM segments) y ON x.recording_id = y.recording_id AND x.speaker < y.speaker))
WHERE low <= 0.99 AND cosine >= 0.99 AND recording_id % 11 <> 0 GROUP BY ALL"""),
    "speaker_counts": _sql("SELECT recording_id, max(n) AS n_speakers FROM (SELECT recording_id, count(DISTINCT speaker_raw) AS n FROM turns GROUP BY recording_id, turn_idx % 2) GROUP BY recording_id"),
    "chunk_overlap_cutoff": _sql("SELECT recording_id, CAST(i AS INT) AS chunk, seg_id, start_ms FROM segments JOIN (SELECT recording_id, max(end_ms) AS n FROM segments GROUP BY ALL) USING (recording_id), range(0, 10000) r(i) WHERE (i = 0 OR i * 26000 + 4000 < n) AND start_ms >= i * 26000 + CASE WHEN i = 0 THEN 0 ELSE 2000 END AND start_ms < least(i * 26000 + 30000, n)"),
    "chosen_run": _sql("SELECT r.* FROM (SELECT *, 0 AS run FROM turns UNION ALL SELECT *, 1 FROM turns WHERE turn_idx % 3 < 2) r LEFT JOIN (SELECT recording_id, min(ms) >= 0.3 * sum(ms) AS more FROM (SELECT recording_id, speaker_raw, sum(end_ms - start_ms) AS ms FROM turns WHERE turn_idx % 3 < 2 GROUP BY ALL) GROUP BY recording_id) USING (recording_id) WHERE run = CASE WHEN more THEN 1 ELSE 0 END"),
    "recogniser_prompts": _sql("SELECT recording_id, seg_id, coalesce(array_to_string(list(substr(text, 1, 120)) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS prompt FROM segments"),
    "energy_speakers": _sql("SELECT recording_id, seg_id, CAST(sum(ch) OVER (PARTITION BY recording_id ORDER BY seg_id) % 6 AS INT) AS speaker_no FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w >= 1500 OR (e > 0 AND lag(e) OVER w > 0 AND greatest(e, lag(e) OVER w) >= 4 * least(e, lag(e) OVER w)) THEN 1 ELSE 0 END AS ch FROM (SELECT *, seg_id * 37 % 11 AS e FROM segments) WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id))"),
    "quote_lines": _sql("SELECT recording_id, substr(string_agg('[' || (start_ms // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || ' ' || speaker || '] ' || text, chr(10) ORDER BY seg_id), 1, 3000) AS block FROM (SELECT *, max(end_ms) OVER (PARTITION BY recording_id) AS m FROM segments) WHERE m >= 300000 AND seg_id < 60 GROUP BY recording_id"),
    "retranslate_context": _sql("SELECT * FROM (SELECT recording_id, seg_id, concat_ws(chr(10), lag(shown, 2) OVER w, lag(shown) OVER w, text, lead(shown) OVER w) AS context FROM (SELECT *, CASE WHEN seg_id % 3 = 0 THEN text ELSE 'PL ' || text END AS shown FROM segments) WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id)) WHERE seg_id % 5 < 2"),
    "retranslated_rows": _sql("SELECT recording_id, seg_id, CASE WHEN seg_id % 5 < 2 AND seg_id % 3 = 2 THEN 'anew ' || text WHEN seg_id % 3 > 0 THEN 'PL ' || text ELSE '' END AS text_pl FROM segments"),
    "unsure_words": _sql("SELECT recording_id, seg_id, count(*) AS n, string_agg(word, ' ' ORDER BY word_idx) AS marked FROM words WHERE prob_pct < 40 GROUP BY recording_id, seg_id"),
    "multi_pass_choice": _sql(r"""SELECT key, CASE WHEN wide THEN text || ' again' WHEN second THEN 'quite other words' ELSE text END AS text, CASE WHEN wide THEN c ELSE chosen END AS confidence, NOT (judged AND greatest(a, b) < 0.3 AND dur < 500) AS kept FROM (SELECT *, chosen < 0.45 AND dur < 3000 AND c > chosen AS wide FROM (SELECT *, judged AND b > a AS second, CASE WHEN judged AND b > a THEN b ELSE a END AS chosen FROM (SELECT *, dur < 800 AND key % 2 = 0 AND len(list_intersect(ws, ['quite', 'other', 'words'])) < 0.4 * len(list_distinct(list_concat(ws, ['quite', 'other', 'words']))) AS judged
  FROM (SELECT recording_id * 1000 + seg_id AS key, end_ms - start_ms AS dur, text, (recording_id * 1000 + seg_id) * 7 % 100 / 100.0::DOUBLE AS a, (recording_id * 1000 + seg_id) * 13 % 100 / 100.0::DOUBLE AS b, (recording_id * 1000 + seg_id) * 31 % 100 / 100.0::DOUBLE AS c, list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')) AS ws FROM segments))))""".replace("\\\\", "\\")),
    "best_candidate": "SELECT user_id, event_id, round(value, 1) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 1) DESC, event_id) AS r FROM events) WHERE r = 1",
    "speaker_profiles": _sql("SELECT recording_id, speaker, count(*) AS n_segments, CASE WHEN speaker <> 'system' THEN 'Kobieta_' || row_number() OVER (PARTITION BY recording_id ORDER BY speaker) END AS display, coalesce(max(end_ms - start_ms) FILTER (end_ms - start_ms > 9000), 0) AS longest_ms FROM segments GROUP BY recording_id, speaker"),
    "probe_summary": "SELECT recording_id, confidence, language, CASE WHEN confidence < 0.6 THEN 'large' WHEN confidence < 0.75 THEN 'context' ELSE 'none' END AS suggestion FROM (SELECT user_id AS recording_id, round(avg(event_id % 100 / 100.0::DOUBLE), 4) AS confidence FROM events GROUP BY ALL) JOIN (SELECT user_id AS recording_id, event_type AS language FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1) USING (recording_id)",
    "probe_positions": _sql("SELECT recording_id, round(unnest(CASE WHEN d > 180 THEN [greatest(30, 0.15::DOUBLE * d), 0.5::DOUBLE * d, 0.8::DOUBLE * d] WHEN d > 90 THEN [greatest(10, 0.2::DOUBLE * d), 0.65::DOUBLE * d] ELSE [least(30, 0.2::DOUBLE * d)] END), 4) AS at, 60.0::DOUBLE AS length FROM (SELECT recording_id, max(end_ms) / 1000.0::DOUBLE AS d FROM segments GROUP BY ALL)"),
}
