"""Operators on segment texts: batches and blocks for translation, windows, entities, exports, batching folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import clock
from confab.operators.jumps import first_at_least, indexed, numbered, reached, running
from confab.operators.segments import REC, joined_text, shown_text
from confab.sources.storage import written


def translation_batches(segs: DataFrame, max_chars: int = 3000, max_rows: int = 15) -> DataFrame:
    """(recording_id, seg_id, batch_id): a batch closes after the row that reaches either limit."""
    n = F.length("text").cast("long")
    rows = written(indexed(segs.select(REC, "seg_id", "text"), {"key": n}).select(REC, "seg_id", "i", "key", (F.col("key") - n + max_chars).alias("least")), "batch-rows")
    ends = first_at_least(rows, max_chars)
    last = F.least(F.coalesce("hit", F.col("i") + max_rows), F.col("i") + max_rows - 1)
    return numbered(rows, reached(_within(ends.select(REC, "i", (last + 1).alias("to")), rows)), "batch_id").select(REC, "seg_id", "batch_id")


def _within(pointers: DataFrame, rows: DataFrame) -> DataFrame:
    """``pointers`` with ``to`` null where the recording has no such row."""
    last = rows.groupBy(REC).agg(F.max("i").alias("_last"))
    return pointers.join(last, REC).withColumn("to", F.when(F.col("to") <= F.col("_last"), F.col("to"))).drop("_last")


def numbered_blocks(segs: DataFrame, batches: DataFrame) -> DataFrame:
    """(recording_id, batch_id, n, block): lines ``k. [speaker] text``, no tag for a blank speaker."""
    rows = segs.join(batches, [REC, "seg_id"])
    k = F.row_number().over(Window.partitionBy(REC, "batch_id").orderBy("seg_id"))
    tag = F.when(F.trim("speaker") != "", F.concat(F.lit("["), F.col("speaker"), F.lit("] "))).otherwise(F.lit(""))
    rows = rows.withColumn("line", F.concat(k.cast("string"), F.lit(". "), tag, F.col("text")))
    return rows.groupBy(REC, "batch_id").agg(F.count(F.lit(1)).alias("n"), joined_text("seg_id", "line", "\n").alias("block"))


def aligned(segs: DataFrame, batches: DataFrame, replies: DataFrame, key: str = "tlumaczenia_pl") -> DataFrame:
    """(recording_id, seg_id, text_pl): the reply's k-th text; missing, blank or broken ones fall back to the original.

    ``replies`` has recording_id, batch_id and reply, a JSON object whose ``key`` holds a list.
    """
    k = F.row_number().over(Window.partitionBy(REC, "batch_id").orderBy("seg_id")) - 1
    rows = segs.join(batches, [REC, "seg_id"]).withColumn("k", k).join(replies, [REC, "batch_id"], "left")
    texts = F.from_json("reply", T.StructType([T.StructField(key, T.ArrayType(T.StringType()))]))[key]
    return rows.select(REC, "seg_id", F.coalesce(F.nullif(F.trim(F.get(texts, F.col("k"))), F.lit("")), F.col("text")).alias("text_pl"))


def translate(segs: DataFrame, translator, language: str = "auto", source_col: str = "text") -> DataFrame:
    """Translates through ``translator(blocks) -> replies``; Polish input passes without any call."""
    if language == "pl":
        return segs.withColumn("text_pl", F.col(source_col))
    batches = translation_batches(segs)
    return segs.join(aligned(segs, batches, translator(numbered_blocks(segs, batches))), [REC, "seg_id"])


def char_windows(texts: DataFrame, width: int = 6000, most: int = 6, overlap: int | None = None) -> DataFrame:
    """(recording_id, window, chunk): one window for short texts, else steps of width less overlap, ``most`` at most."""
    over = min(600, width // 10) if overlap is None else overlap
    n = F.length("text")
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(width - over)))
    cut = texts.select(REC, "text", F.posexplode(F.slice(starts, 1, most)).alias("window", "at"))
    return cut.select(REC, "window", F.substring("text", F.col("at") + 1, F.lit(width)).alias("chunk"))


def transcripts(segs: DataFrame) -> DataFrame:
    """(recording_id, text): what is shown of each row, in order; a blank row leaves its space."""
    return segs.select(REC, "seg_id", shown_text(segs).alias("text")).groupBy(REC).agg(joined_text().alias("text"))


def merged_entities(found: DataFrame, keep_order: bool = False, keywords: int = 20) -> DataFrame:
    """(recording_id, kind, values): union of trimmed non-empty values, sorted or in order of appearance.

    ``found`` has recording_id, window, kind, pos and value; keywords are cut to ``keywords``.
    """
    rows = found.withColumn("value", F.trim("value")).filter("value <> ''").groupBy(REC, "kind", "value").agg(F.min(F.struct("window", "pos")).alias("first"))
    order = F.struct("first", "value") if keep_order else F.struct(F.col("value"), F.col("first"))
    values = F.transform(F.array_sort(F.collect_list(order)), lambda s: s["value"])
    rows = rows.groupBy(REC, "kind").agg(values.alias("values"))
    return rows.withColumn("values", F.when(F.col("kind") == "keyword", F.slice("values", 1, keywords)).otherwise(F.col("values")))


def exported(segs: DataFrame) -> DataFrame:
    """(recording_id, export): ``[m:ss - m:ss] name: text``, with the original below where it was translated."""
    head = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit(" - "), clock(F.col("end_ms")), F.lit("] "), F.col("speaker"), F.lit(": "))
    shown = F.coalesce(F.nullif("text_pl", F.lit("")), "text")
    line = F.concat(head, shown, F.when(shown != F.col("text"), F.concat(F.lit("\n  ("), F.col("text"), F.lit(")"))).otherwise(F.lit("")))
    return segs.withColumn("line", line).groupBy(REC).agg(joined_text("seg_id", "line", "\n").alias("export"))


def topic_windows(segs: DataFrame, width_ms: int = 300_000, most: int = 8, chars: int = 1000) -> DataFrame:
    """(recording_id, win_id, start_ms, end_ms, n, text): windows anchored at the segment that opens them, the first at 0.

    A segment opens a window if it starts ``width_ms`` or more after the one before did. All segments before an
    opener start earlier than it, so the first running maximum to get there is the opener itself.
    """

    far = F.lit(-(1 << 62))
    rows = indexed(segs.select(REC, "seg_id", "start_ms"))
    rows = running(rows.withColumn("_own", F.when(F.col("i") > 0, F.col("start_ms")).otherwise(far)), {"key": F.col("_own").cast("long")}, "i", F.max)
    rows = written(rows.select(REC, "seg_id", "i", F.greatest("key", F.lit(-width_ms)).alias("key"), (F.when(F.col("i") > 0, F.col("start_ms")).otherwise(0) + width_ms).cast("long").alias("least")), "window-rows")
    opens = reached(first_at_least(rows, width_ms).select(REC, "i", F.when(F.col("hit") > F.col("i"), F.col("hit")).alias("to")))
    rows = segs.join(numbered(rows, opens, "win_id").select(REC, "seg_id", "win_id"), [REC, "seg_id"]).filter(F.col("win_id") < most)
    return rows.groupBy(REC, "win_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"), F.substring(joined_text(), 1, chars).alias("text"))


def sliding_chunks(segs: DataFrame, back: int = 2, least_rows: int = 3, least_chars: int = 600) -> DataFrame:
    """(recording_id, chunk_id, first_idx, last_idx, text): each chunk repeats the last ``back`` rows and adds one at least."""

    n = F.length("text").cast("long")
    rows = written(indexed(segs.select(REC, "seg_id", "text"), {"key": n}).select(REC, "seg_id", "text", "i", "key", (F.col("key") - n + least_chars).alias("least")), "chunk-rows")
    ends = first_at_least(rows.select(REC, "i", "key", "least"), max(1, least_chars))
    least_last = F.col("i") + F.when(F.col("i") > 0, max(least_rows - 1, back)).otherwise(least_rows - 1)
    ends = written(_within(ends.select(REC, "i", (F.greatest("hit", least_last, F.col("i")) + 1).alias("to"), F.col("hit").isNull().alias("_open")), rows), "chunk-ends")
    begins = reached(ends.select(REC, "i", F.when(~F.col("_open"), F.col("to") - back).alias("to")))
    chunk = F.row_number().over(Window.partitionBy(REC).orderBy("i")) - 1
    spans = begins.join(ends, [REC, "i"]).join(rows.groupBy(REC).agg(F.max("i").alias("_last")), REC)
    last = F.when(F.col("_open") | F.col("to").isNull(), F.col("_last")).otherwise(F.col("to") - 1)
    spans = spans.select(REC, "i", chunk.alias("chunk_id"), last.alias("_end")).select(REC, "chunk_id", F.explode(F.sequence("i", "_end")).alias("i"))
    rows = spans.join(rows.select(REC, "i", "seg_id", "text"), [REC, "i"])
    return rows.groupBy(REC, "chunk_id").agg(F.min("seg_id").alias("first_idx"), F.max("seg_id").alias("last_idx"), joined_text().alias("text"))
