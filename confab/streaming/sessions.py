"""Session state as tables: append, replace, patch, upsert and replay of event streams.

The batch forms take any DataFrame. ``replayed`` runs a Structured Streaming query over files with the
same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.sources.storage import scratch_path
from confab.streaming.stateful import merged_log, run_stream


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key, the first; later ones are unseen."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last snapshot of each key, whole."""
    own = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.col(order)).alias("s")).select(key, "s.*")


def appended(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def patched_by_position(rows: DataFrame, updates: DataFrame, key: list[str], column: str, order: str) -> DataFrame:
    """``column`` from the first update of each key."""
    first = first_wins(updates, key, order).select(*key, F.col(column).alias("_new"))
    return rows.join(first, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def patched_by_id(rows: DataFrame, updates: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """``column`` from the last update of each key."""
    last = updates.groupBy(key).agg(F.max_by(F.col(column), F.col(order)).alias("_new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def upserted(maps: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Map ``names`` of each key with the last value of each name (key, name, value, seq)."""
    last = updates.groupBy(key, "name").agg(F.max_by("value", "seq").alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_new"))
    kept = F.map_filter(F.coalesce("names", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    return maps.join(last, key, "full_outer").select(key, F.map_concat(kept, F.coalesce("_new", F.create_map().cast("map<string,string>"))).alias("names"))


def edited_word(rows: DataFrame, at: int, word: str) -> DataFrame:
    """Replaces the word at ``at`` by ``word``, trimmed, behind the white space it had; clears its alternatives, rebuilds text and text_pl."""
    new = lambda w: F.concat(F.regexp_extract(w["text"], r"(?U)^\s*", 0), F.regexp_replace(F.lit(word), r"(?U)^\s+|\s+$", ""))
    edit = lambda w, i: F.when(i == at, F.struct(new(w).alias("text"), F.array().cast("array<string>").alias("alternatives"))).otherwise(F.struct(w["text"].alias("text"), w["alternatives"].alias("alternatives")))
    rows = rows.withColumn("words", F.transform("words", edit))
    text = F.regexp_replace(F.array_join(F.transform("words", lambda w: w["text"]), ""), r"(?U)^\s+|\s+$", "")
    return rows.withColumns({"text": text, "text_pl": text})


def edited_text(rows: DataFrame, edits: DataFrame, key: list[str], order: str) -> DataFrame:
    """``rows`` with text and text_pl of the last of ``edits`` (key, text, order) for each key; words and alternatives stay."""
    last = edits.groupBy(*key).agg(F.max_by("text", order).alias("_new"))
    rows = rows.join(last, key, "left")
    old = F.col("text_pl") if "text_pl" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"text_pl": F.coalesce("_new", old), "text": F.coalesce("_new", "text")}).drop("_new")


def running_index(chunks: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Index of each chunk's first item among all of its key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("first_index", F.coalesce(F.sum(size).over(before), F.lit(0)))


def event_log(events: DataFrame, key: str, order: str, hidden: tuple[str, ...] = (), most: int = 12) -> DataFrame:
    """The last ``most`` events of each key that aren't of a hidden kind."""
    rows = events.filter(~F.col("event_type").isin(*hidden)) if hidden else events
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("recency") <= most)


def session_states(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n, total): events of a user without a longer pause."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    g = events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n", "total")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n): works on streams with late data, and in batch."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def replayed(rows: DataFrame, transform, mode: str = "complete", files: int = 8, key: list[str] | None = None) -> DataFrame:
    """Writes ``rows`` as ``files`` files, runs ``transform`` over them as a stream, several files a batch, to the end.

    Gives what the sink holds then: in complete mode the last batch, in update mode the last row of each ``key``. Sink, state and progress are
    kept in the shared folder.
    """
    spark = rows.sparkSession
    path, log = scratch_path(spark, "stream"), scratch_path(spark, "log")
    rows.repartition(files).write.parquet(path)
    run_stream(path, rows.schema, transform, log, scratch_path(spark, "progress"), mode, max(1, files // 3))
    return merged_log(spark, log, transform(rows).schema if mode == "complete" else spark.read.parquet(log).drop("batch").schema, key)
