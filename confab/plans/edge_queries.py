"""Queries at the engine's edges: imports, streams, memories, audio, model boundaries and edits, with their oracles.

Model calls are stood in for by functions whose answers SQL can give too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import text as t
from confab.operators import asr, flows, profiles, retrieval
from confab.operators import models as m
from confab.operators import text as x
from confab.plans.segment_queries import _segs, _segs_words, _sql
from confab.plans.text_queries import _CHUNKS
from confab.sources import conversations as c
from confab.sources import audio
from confab.sources import transcripts as tr
from confab.streaming import sessions as st

REC = "recording_id"
_SAID = ("Mhm!", "aha", "[laugh]", "well then", "Uhh...", "[MUSIC]", "hm?")


def _events(op):
    return lambda spark, d: op(c.table(spark, d, "events"))


def _ordered(*fields):
    return F.array_sort(F.collect_list(F.struct("seg_id", *fields)))


def _documents(segs, whole: bool):
    """Each recording as the JSON of a transcript; every fourth row lacks its speaker, every third its text."""
    row = F.struct((F.col("seg_id") + 100).alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.when(F.col("seg_id") % 3 > 0, F.col("text")).alias("text"), F.when(F.col("seg_id") % 4 > 0, F.col("speaker")).alias("speaker"))
    g = segs.withColumn("row", row).groupBy(REC).agg(F.transform(_ordered("row"), lambda s: s["row"]).alias("segments"))
    body = F.to_json(F.struct("segments", F.lit("pl").alias("detected_language"))) if whole else F.to_json("segments")
    return g.select(REC, F.when(F.col(REC) % 10 == 9, F.lit('{"other": 1}')).otherwise(body).alias("json"))


def _imported(whole):
    return _segs(lambda s: tr.imported(_documents(s, whole), renumber=not whole).select(REC, "language", "seg_id", "start_ms", "end_ms", "text", "speaker"))


def _lines(e):
    return e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('data: {"type": "'), "event_type", F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit("data: broken")).otherwise(F.lit(": ping")).alias("value"))


def _deltas(segs):
    lines = segs.select(F.col(REC).alias("stream"), F.col("seg_id").alias("pos"), F.when(F.col("seg_id") % 5 == 4, F.lit('{"done": true}')).otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))).alias("value"))
    return tr.chat_text(lines)


def _memories(e, keep=None):
    """Every event as a memory; with ``keep``, those of even or odd ids, which are known and new ones."""
    own = e if keep is None else e.filter(F.col("event_id") % 2 == keep)
    return own.select(F.col("event_id").alias("id"), F.col("event_id").alias("created"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 40).cast("string")).alias("observation"), F.when(F.col("event_id") % 3 == 0, "high").otherwise("low").alias("importance"))


def _wav(e):
    """Mono WAV files of eight equal samples, made of the event's id."""
    header = "524946463400000057415645666D74201000000001000100803E0000007D0000020010006461746110000000"
    return e.select(F.col("event_id").cast("string").alias("path"), F.unhex(F.concat(F.lit(header), F.repeat(F.concat(F.lpad(F.hex(F.col("event_id") % 128), 2, "0"), F.lpad(F.hex(F.col("user_id") % 64), 2, "0")), 8))).alias("content"))


def _pcm(segs):
    return segs.groupBy(REC).agg(F.transform(_ordered(((F.col("end_ms") - F.col("start_ms")) / 25000.0).alias("v")), lambda s: s["v"]).alias("pcm"))


def _frames(segs):
    """A frame of 1 s with one sample, its number, for every second of a recording."""
    return segs.groupBy(REC).agg(F.max("end_ms").alias("n")).select(REC, F.explode(F.sequence(F.lit(0), F.expr("cast(n div 1000 as int)"))).alias("frame_idx")).withColumn("samples", F.array(F.col("frame_idx").cast("double")))


def _heard(segs):
    """Tones of each speaker, louder and softer in turn, and what the extractors make of them."""
    wave = F.transform(F.sequence(F.lit(0), F.lit(15_999)), lambda i: F.when((i / 2000).cast("int") % 2 == 0, F.sin(i * 0.05) * 0.5).otherwise(0.0))
    rows = segs.select(REC, "speaker").distinct().withColumn("pcm", wave)
    got = profiles.extracted(rows)
    return got.select(REC, "speaker", F.round(F.col("features")["speech_rate"], 3).alias("rate"), profiles.rate_label(F.col("features")["speech_rate"]).alias("label"))


def _listened(segs):
    chunks = segs.groupBy(REC).agg(F.max("end_ms").alias("n")).select(REC, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(30_000).cast("long"))).alias("start_ms"))
    chunks = chunks.withColumns({"chunk": F.expr("cast(start_ms div 30000 as int)"), "samples": F.array(F.col("start_ms").cast("double"))})
    return asr.transcribed(chunks, lambda samples, settings: [(0, 500, f"at {int(samples[0])}"), (500, 900, settings["language"] or "auto")])


def _assembled(segs):
    people = segs.groupBy(REC, "speaker").agg(F.count(F.lit(1)).alias("n")).filter("speaker <> 'system'")
    found = segs.groupBy(REC).agg(F.array_sort(F.collect_set("speaker")).alias("values")).withColumn("kind", F.lit("person"))
    whole = asr.assembled(segs.filter(F.col(REC) % 7 > 0), people, found)
    return whole.select(REC, F.coalesce(F.size("segments"), F.lit(-1)).alias("n_segments"), F.coalesce(F.size("profiles"), F.lit(-1)).alias("n_profiles"), F.array_join(F.col("entities")["person"], ",").alias("people"), "error")


def _conflicts(customers):
    one = lambda k: F.struct(F.when(k % 3 == 0, "meski").otherwise("zenski").alias("gender"), (k % 10 / 10).alias("confidence"), F.when(k % 4 > 0, k % 70).alias("age"))
    pairs = customers.select("c_custkey", one(F.col("c_custkey")).alias("a"), one(F.col("c_custkey") + 1).alias("b"))
    return pairs.select("c_custkey", m.profile_conflict(F.col("a"), F.col("b")).alias("conflict"))


def _replies(segs):
    names = F.when(F.col(REC) % 3 == 0, F.lit('Sure: {"user": "Ada", "assistant": "null"} {"user": "late"}')).when(F.col(REC) % 3 == 1, F.lit('{"user": " Bob ", "system": "Unknown"}')).otherwise(F.lit("nothing"))
    return m.named_speakers(segs.select(REC).distinct().withColumn("reply", names))


def _translated(segs):
    def translator(blocks):
        lines = F.transform(F.split("block", "\n"), lambda l: F.concat(F.lit("PL "), F.regexp_replace(l, r"^\d+\. \[[a-z]+\] ", "")))
        return blocks.select(REC, "batch_id", F.to_json(F.struct(lines.alias("tlumaczenia_pl"))).alias("reply"))

    return x.translate(segs, translator, "en").select(REC, "seg_id", "text_pl")


def _json_texts(e):
    body = F.concat(F.lit('{"a": {"b": '), F.col("event_id").cast("string"), F.lit("}}"))
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x "), body, F.lit(" y"))).when(F.col("event_id") % 3 == 1, F.lit("none")).otherwise(body)
    return e.select("event_id", t.first_json(s).alias("outer"), t.first_json(s, greedy=False).alias("inner"))


def _embedded(segs):
    chunks = x.sliding_chunks(segs).select(REC, "chunk_id", "text")
    return m.embedded(chunks, lambda texts: [[float(len(s)), 1.0] for s in texts], 2).select(REC, "chunk_id", F.element_at("embedding", 1).cast("double").alias("first"))


def _hits(segs):
    hits = segs.select(F.col(REC).alias("query_id"), F.col("seg_id").cast("long").alias("vec_id"), ((F.col("seg_id") * 7 % 10) / 10.0).alias("score"))
    chunks = segs.select(F.col("seg_id").cast("long").alias("vec_id")).distinct().withColumn("segment_ids", F.when(F.col("vec_id") % 6 == 5, F.array().cast("array<int>")).otherwise(F.sequence(F.expr("cast(vec_id div 3 as int)"), F.expr("cast(vec_id div 3 as int) + 2"))))
    return retrieval.hit_segments(hits, chunks)


def _cut_stream(events):
    """Each user's events as one stream of lines, cut every 7 to 23 bytes; the last line lacks its end, every fifth is no event."""
    line = F.concat(F.when(F.col("event_id") % 5 == 0, ": ").otherwise("data: "), F.lit('{"type": "'), "event_type", F.lit('", "name": "gł'), "event_id", F.lit('"}'))
    body = events.groupBy(F.col("user_id").alias("stream")).agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n"), "UTF-8").alias("b"))
    step = (7 + F.col("stream") % 17).cast("int")
    cut = body.select("stream", "b", step.alias("s"), F.posexplode(F.sequence(F.lit(1), F.length("b"), step)).alias("pos", "at"))
    return cut.select("stream", "pos", F.expr("substring(b, at, s)").alias("data"))


def _ranges(segs):
    """A file for each speaker of a recording, a sample for each segment, read back in ranges of seven samples."""
    own = segs.groupBy(REC, "speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "end_ms", "start_ms"))), lambda x: (x["end_ms"] - x["start_ms"]).cast("int")).alias("pcm"))
    paths = audio.write_waves(own.select(F.concat_ws("-", REC, "speaker").alias("name"), "pcm"))
    rows = audio.read_ranges(segs.sparkSession, paths, 16_000, 7)
    at = F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 32768)).cast("long")
    return rows.groupBy(F.regexp_extract("path", r"([^/]+)[.]wav$", 1).alias("name")).agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.size("samples")).cast("long").alias("n_samples"), F.sum(at).alias("total"))


def _edited(segs, words):
    own = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda w: F.struct(F.concat(F.when(w["word_idx"] % 2 == 1, "\t ").when(w["word_idx"] > 0, " ").otherwise(""), w["word"]).alias("text"), F.array(F.lit("alt")).alias("alternatives")))
    rows = words.groupBy(REC, "seg_id").agg(own.alias("words"))
    return st.edited_word(rows, 1, " EDIT ").select(REC, "seg_id", "text", "text_pl", F.aggregate("words", F.lit(0), lambda a, w: a + F.size(w["alternatives"])).alias("n_alternatives"))


def _overwritten(conv):
    chat = conv.select(F.col("conv_id").alias(REC), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    return asr.last_overwritten(chat, chat.select(REC).distinct().filter(F.col(REC) % 2 == 0).withColumn("content", F.lit("new"))).select(REC, "pos", "role", "content")


QUERIES = {
    "transcript_import": _imported(False),
    "transcript_reimport": _imported(True),
    "transcript_rejects": _segs(lambda s: tr.rejected(_documents(s, True))),
    "timestamps": _events(lambda e: e.select("event_id", t.seconds_of(F.expr("CASE event_id % 5 WHEN 0 THEN concat_ws(':', event_id % 30, event_id % 60, event_id % 59) WHEN 1 THEN concat_ws(':', event_id % 60, event_id % 59) WHEN 2 THEN concat(event_id % 59, '.5') WHEN 3 THEN 'N/A' ELSE '' END")).alias("seconds"))),
    "speaker_numbering": _segs(lambda s: tr.numbered_speakers(s.withColumn("text", F.when(F.col("seg_id") % 6 == 0, " ").otherwise(F.col("text"))))),
    "audio_ranges": _segs(_ranges),
    "event_stream_chunks": _events(lambda e: tr.event_lines(tr.stitched_lines(_cut_stream(e)))),
    "event_stream_lines": _events(lambda e: tr.event_lines(_lines(e))),
    "chat_stream_text": _segs(_deltas),
    "memories_saved": _events(lambda e: tr.saved_memories(_memories(e, 0), _memories(e, 1))),
    "memory_prompt": _events(lambda e: tr.memory_prompt(_memories(e))),
    "memories_forgotten": _events(lambda e: asr.forgotten(_memories(e), list(range(0, 1000, 4))).select("id", "observation")),
    "audio_decode": _events(lambda e: tr.decoded_audio(_wav(e)).select("path", "seconds", F.size("pcm").alias("n"), F.round(F.element_at("pcm", 8).cast("double"), 6).alias("last"))),
    "segment_energy": _segs(lambda s: _pcm(s).select(REC, F.round(profiles.energy(F.col("pcm"), F.lit(1.0), F.lit(4.5), 1), 8).alias("energy"))),
    "speaker_audio": _segs(lambda s: profiles.speaker_audio(s, _frames(s), 1000).select(REC, "speaker", F.size("pcm").alias("n"), F.aggregate("pcm", F.lit(0.0), lambda a, v: a + v).alias("total"))),
    "speaker_features": _segs(_heard),
    "sound_badges": _events(lambda e: e.select("event_id", F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % len(_SAID) + 1).cast("int")).alias("said")).select("event_id", profiles.sound_badge(F.col("said")).alias("badge"))),
    "transcribed_chunks": _segs(_listened),
    "assembled_results": _segs(_assembled),
    "profile_conflicts": lambda spark, d: _conflicts(c.table(spark, d, "customer")),
    "identified_speakers": _segs(_replies),
    "segment_translation": _segs(_translated),
    "model_replies": _events(lambda e: m.called(e.select("event_id", F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("p")), "p", lambda prompts: [p.upper() if not p.endswith("3") else None for p in prompts]).select("event_id", "reply")),
    "quality_verdicts": _segs(lambda s: flows.quality_verdict(s.select(REC, "seg_id", ((F.col("seg_id") * 7 + F.col(REC)) % 5 + 1).alias("score")))),
    "prompt_texts": _segs(lambda s: asr.prompted(x.transcripts(s), "entities").select(REC, "prompt")),
    "json_extracts": _events(_json_texts),
    "embedded_chunks": _segs(_embedded),
    "hit_segments": _segs(_hits),
    "edited_words": _segs_words(_edited),
    "chat_overwrite": lambda spark, d: _overwritten(c.table(spark, d, "conversations")),
}

_MEM = "SELECT event_id AS id, event_id AS created, event_type || ' ' || (event_id % 40) AS observation, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS importance, event_id % 2 AS new_ FROM events"
_ROWS = "SELECT recording_id, {0} AS language, {1} AS seg_id, CAST(round(start_ms / 1000.0::DOUBLE * 1000) AS BIGINT) AS start_ms, CAST(round(end_ms / 1000.0::DOUBLE * 1000) AS BIGINT) AS end_ms, CASE WHEN seg_id % 3 > 0 THEN text ELSE '' END AS text, CASE WHEN seg_id % 4 > 0 THEN speaker ELSE 'GŁOS_01' END AS speaker FROM segments WHERE recording_id % 10 <> 9"
_BADGE = " ".join(f"WHEN {i} THEN {repr(profiles.SOUND_BADGES[b]) if b else 'NULL'}" for i, b in enumerate(("mhm", "aha", "[laugh]", None, "uhh", "[music]", "hm")))

ORACLES = {
    "transcript_import": _sql(_ROWS.format("'auto'", "seg_id")),
    "transcript_reimport": _sql(_ROWS.format("'pl'", "seg_id + 100")),
    "transcript_rejects": _sql("SELECT DISTINCT recording_id, 'no array of segments' AS error FROM segments WHERE recording_id % 10 = 9"),
    "timestamps": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 30 * 3600 + event_id % 60 * 60 + event_id % 59 WHEN 1 THEN event_id % 60 * 60 + event_id % 59 WHEN 2 THEN event_id % 59 + 0.5 ELSE 0 END::DOUBLE AS seconds FROM events",
    "speaker_numbering": _sql("SELECT recording_id, seg_id, label, text FROM segments JOIN (SELECT recording_id, speaker, printf('GŁOS_%02d', row_number() OVER (PARTITION BY recording_id ORDER BY min(seg_id))) AS label FROM segments GROUP BY recording_id, speaker) USING (recording_id, speaker) WHERE seg_id % 6 <> 0"),
    "audio_ranges": _sql("SELECT recording_id || '-' || speaker AS name, CAST(ceil(count(*) / 7.0) AS BIGINT) AS n_ranges, count(*) AS n_samples, CAST(sum(end_ms - start_ms) AS BIGINT) AS total FROM segments GROUP BY recording_id, speaker"),
    "event_stream_chunks": """SELECT '{"type": "' || event_type || '", "name": "gł' || event_id || '"}' AS value, event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE event_id % 5 > 0 AND r > 1""",
    "event_stream_lines": """SELECT '{"type": "' || event_type || '", "id": ' || event_id || '}' AS value, event_type AS type FROM events WHERE event_id % 3 = 0""",
    "chat_stream_text": _sql("SELECT recording_id AS stream, string_agg(text, '' ORDER BY seg_id) AS content FROM segments WHERE seg_id % 5 <> 4 GROUP BY recording_id"),
    "memories_saved": f"SELECT id, created, observation, importance FROM (SELECT *, row_number() OVER (PARTITION BY left(lower(trim(observation)), 80) ORDER BY new_, created, id) AS r FROM ({_MEM})) WHERE r = 1 ORDER BY created DESC, id DESC LIMIT 50",
    "memory_prompt": f"SELECT string_agg('- [' || importance || '] ' || observation, chr(10) ORDER BY created DESC) AS prompt FROM (SELECT * FROM ({_MEM}) ORDER BY created DESC LIMIT 8)",
    "memories_forgotten": f"SELECT id, observation FROM ({_MEM}) WHERE NOT (id < 1000 AND id % 4 = 0)",
    "audio_decode": "SELECT CAST(event_id AS VARCHAR) AS path, 0.0::DOUBLE AS seconds, 8 AS n, round((event_id % 128 + user_id % 64 * 256) / 32768.0::DOUBLE, 6) AS last FROM events",
    "segment_energy": _sql("SELECT recording_id, round(coalesce(sqrt(avg(v * v) FILTER (seg_id BETWEEN 1 AND 4)), 0), 8) AS energy FROM (SELECT *, (end_ms - start_ms) / 25000.0::DOUBLE AS v FROM segments) GROUP BY recording_id"),
    "speaker_audio": _sql("SELECT recording_id, speaker, count(*) AS n, sum(f)::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY f) AS r FROM (SELECT DISTINCT recording_id, speaker, unnest(range(start_ms // 1000, (end_ms - 1) // 1000 + 1)) AS f FROM segments WHERE end_ms - start_ms >= 500)) WHERE r <= 90 GROUP BY ALL"),
    "sound_badges": f"SELECT event_id, CASE event_id % {len(_SAID)} {_BADGE} END AS badge FROM events",
    "transcribed_chunks": _sql("SELECT recording_id, CAST(k AS INT) AS chunk, CAST(p AS INT) AS pos, k * 30000 + p * 500 AS start_ms, k * 30000 + CASE WHEN p = 0 THEN 500 ELSE 900 END AS end_ms, CASE WHEN p = 0 THEN 'at ' || k * 30000 ELSE 'auto' END AS text FROM (SELECT recording_id, unnest(range((max(end_ms) - 1) // 30000 + 1)) AS k FROM segments GROUP BY recording_id), range(2) r(p)"),
    "assembled_results": _sql("SELECT recording_id, CAST(CASE WHEN recording_id % 7 > 0 THEN count(*) ELSE -1 END AS INT) AS n_segments, CAST(CASE WHEN count(*) FILTER (speaker <> 'system') > 0 THEN count(DISTINCT speaker) FILTER (speaker <> 'system') ELSE -1 END AS INT) AS n_profiles, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS people, CASE WHEN recording_id % 7 = 0 THEN 'no segments' END AS error FROM segments GROUP BY recording_id"),
    "profile_conflicts": """SELECT k AS c_custkey, (k % 3 = 0) <> ((k + 1) % 3 = 0) AND k % 10 > 7 AND (k + 1) % 10 > 7 OR (k % 4 > 0 AND (k + 1) % 4 > 0 AND k % 70 <> 0 AND (k + 1) % 70 <> 0 AND abs(k % 70 - (k + 1) % 70) > 15) AS conflict FROM (SELECT c_custkey AS k FROM customer)""",
    "identified_speakers": _sql("SELECT DISTINCT recording_id, 'user' AS speaker, CASE WHEN recording_id % 3 = 0 THEN 'Ada' ELSE 'Bob' END AS name FROM segments WHERE recording_id % 3 < 2"),
    "segment_translation": _sql("SELECT recording_id, seg_id, 'PL ' || text AS text_pl FROM segments"),
    "model_replies": "SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN upper(event_type || event_id % 7) END AS reply FROM events",
    "quality_verdicts": _sql("SELECT recording_id, round(avg(s), 4) AS average, arg_min(seg_id, s * 100000 + seg_id) AS worst, round(avg(s), 4) < 3.0 AS retranslate, round(avg(s), 4) < 3.5 AS recommended FROM (SELECT *, (seg_id * 7 + recording_id) % 5 + 1 AS s FROM segments) GROUP BY recording_id"),
    "prompt_texts": _sql("SELECT recording_id, 'List people, places, organisations, dates and keywords as JSON:' || chr(10) || substr(string_agg(text, ' ' ORDER BY seg_id), 1, 4000) AS prompt FROM segments GROUP BY recording_id"),
    "json_extracts": """SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN '{"a": {"b": ' || event_id || '}}' END AS "outer", CASE WHEN event_id % 3 <> 1 THEN '{"b": ' || event_id || '}' END AS "inner" FROM events""",
    "embedded_chunks": _sql("SELECT c.recording_id, CAST(chunk_id AS INT) AS chunk_id, length(string_agg(text, ' ' ORDER BY s.seg_id))::DOUBLE AS first FROM chunks_ c JOIN segments s ON s.recording_id = c.recording_id AND s.seg_id BETWEEN first_idx AND last_idx GROUP BY c.recording_id, chunk_id", _CHUNKS).replace("WITH ", "WITH RECURSIVE ", 1),
    "hit_segments": _sql("SELECT query_id, seg_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seg_id ORDER BY score DESC, vec_id) AS r FROM (SELECT recording_id AS query_id, seg_id AS vec_id, CAST(seg_id // 3 AS INT) AS seg_id, seg_id * 7 % 10 / 10.0::DOUBLE AS score FROM segments WHERE seg_id % 6 <> 5)) WHERE r = 1"),
    "edited_words": _sql("SELECT *, text AS text_pl FROM (SELECT recording_id, seg_id, trim(string_agg(CASE WHEN word_idx % 2 = 1 THEN chr(9) || ' ' WHEN word_idx > 0 THEN ' ' ELSE '' END || CASE WHEN word_idx = 1 THEN 'EDIT' ELSE word END, '' ORDER BY word_idx)) AS text, CAST(count(*) FILTER (word_idx <> 1) AS INT) AS n_alternatives FROM words GROUP BY recording_id, seg_id)"),
    "chat_overwrite": "SELECT conv_id AS recording_id, turn AS pos, role, CASE WHEN conv_id % 2 = 0 AND role = 'assistant' AND turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) THEN 'new' ELSE text END AS content FROM conversations",
}
