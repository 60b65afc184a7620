"""Conversation tables as the engine's domain: sentences, timed segments, words and speaker turns.

Times are whole milliseconds derived from text lengths, so every sum is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, pos, text): non-blank sentences of each turn."""
    cut = conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.]\s+|\n+")).alias("pos", "t"))
    return cut.select("conv_id", "turn", "role", "pos", F.trim("t").alias("text")).filter("text <> ''")


def segments(conversations: DataFrame) -> DataFrame:
    """(recording_id, seg_id, turn, speaker, text, start_ms, end_ms), one row per sentence."""
    order = Window.partitionBy("recording_id").orderBy("seg_id")
    rows = sentences(conversations).withColumnRenamed("conv_id", "recording_id")  # renamed first: every window below keeps one partitioning
    rows = rows.select("recording_id", "turn", "role", "text", (F.row_number().over(Window.partitionBy("recording_id").orderBy("turn", "pos")) - 1).alias("seg_id"))
    rows = rows.withColumn("h", (F.col("recording_id") * 7919 + F.col("seg_id") * 104729) % 13)
    h = F.col("h")
    dur = F.greatest(F.lit(100), F.least(F.length("text") * F.when(h.isin(4, 9), 10).otherwise(60), F.lit(25000)))
    gap = F.when(h == 0, 12000).when(h.isin(1, 2), 4000).when(h.isin(3, 5), 800).when(h.isin(6, 7), 40).when(h == 8, -300).otherwise(0)
    rows = rows.withColumns({"dur": dur, "gap": gap, "speaker": F.when(h == 9, "system").otherwise(F.col("role"))})
    before = F.coalesce(F.sum(F.col("gap") + F.col("dur")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.greatest(F.lit(0), before + F.col("gap")).cast("long")
    return rows.withColumn("start_ms", start).select("recording_id", "seg_id", "turn", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("dur")).cast("long").alias("end_ms"))


def words(segs: DataFrame) -> DataFrame:
    """(recording_id, seg_id, word_idx, word, prob_pct)."""
    cut = segs.select("recording_id", "seg_id", F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    return cut.withColumn("prob_pct", ((F.col("recording_id") * 31 + F.col("seg_id") * 17 + F.col("word_idx") * 7) % 101).cast("int"))


def turns(segs: DataFrame, conversations: DataFrame) -> DataFrame:
    """(recording_id, turn_idx, speaker_raw, start_ms, end_ms): turns as a diarizer would jitter them."""
    c = conversations.select(F.col("conv_id").alias("recording_id"), "turn", "role")
    g = segs.join(c, ["recording_id", "turn"]).groupBy("recording_id", "turn").agg(F.max("role").alias("speaker_raw"), F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    start = F.greatest(F.lit(0), F.col("a") - 150 + (F.col("recording_id") * 37 + F.col("turn") * 53) % 500)
    end = F.col("b") + (F.col("recording_id") * 41 + F.col("turn") * 59) % 400
    return g.select("recording_id", F.col("turn").cast("int").alias("turn_idx"), "speaker_raw", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))


#: The same views in DuckDB, for the oracle queries.
VIEWS_SQL = r"""
sentences AS (
  SELECT conv_id, turn, role, pos, trim(t) AS text FROM (
    SELECT conv_id, turn, role, generate_subscripts(regexp_split_to_array(text, '[.]\s+|\n+'), 1) - 1 AS pos, unnest(regexp_split_to_array(text, '[.]\s+|\n+')) AS t FROM conversations
  ) WHERE trim(t) <> ''
), numbered AS (
  SELECT *, (recording_id * 7919 + seg_id * 104729) % 13 AS h FROM (
    SELECT conv_id AS recording_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS INT) AS seg_id FROM sentences
  )
), timed AS (
  SELECT *, greatest(100, least(length(text) * CASE WHEN h IN (4, 9) THEN 10 ELSE 60 END, 25000)) AS dur,
    CASE WHEN h = 0 THEN 12000 WHEN h IN (1, 2) THEN 4000 WHEN h IN (3, 5) THEN 800 WHEN h IN (6, 7) THEN 40 WHEN h = 8 THEN -300 ELSE 0 END AS gap,
    CASE WHEN h = 9 THEN 'system' ELSE role END AS speaker FROM numbered
), segments AS (
  SELECT recording_id, seg_id, turn, speaker, text, CAST(greatest(0, before + gap) AS BIGINT) AS start_ms, CAST(greatest(0, before + gap) + dur AS BIGINT) AS end_ms FROM (
    SELECT *, coalesce(sum(gap + dur) OVER (PARTITION BY recording_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM timed
  )
), words AS (
  SELECT recording_id, seg_id, CAST(pos AS INT) AS word_idx, w AS word, CAST((recording_id * 31 + seg_id * 17 + pos * 7) % 101 AS INT) AS prob_pct FROM (
    SELECT recording_id, seg_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS w FROM segments
  )
), turns AS (
  SELECT recording_id, CAST(turn AS INT) AS turn_idx, max(role) AS speaker_raw,
    CAST(greatest(0, min(start_ms) - 150 + (recording_id * 37 + turn * 53) % 500) AS BIGINT) AS start_ms,
    CAST(max(end_ms) + (recording_id * 41 + turn * 59) % 400 AS BIGINT) AS end_ms
  FROM (SELECT s.*, c.role FROM segments s JOIN conversations c ON c.conv_id = s.recording_id AND c.turn = s.turn) GROUP BY recording_id, turn
)
"""
