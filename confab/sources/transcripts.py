"""Readers and writers at the engine's edge: transcripts, event lines, memories and audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_SPEAKER = "GŁOS_01"
_WORD = "struct<text:string,start:double,end:double,probability:double,alternatives:array<string>>"
_SEGMENT = f"struct<id:int,start:double,end:double,text:string,text_pl:string,speaker:string,words:array<{_WORD}>>"


def parsed_segments(segments: Column, renumber: bool, speaker: str) -> Column:
    """Coerces an array of segment structs: absent times 0, text '', probability 1, blank alternatives dropped."""
    word = lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["start"], F.lit(0.0)).alias("start"), F.coalesce(w["end"], F.lit(0.0)).alias("end"), F.coalesce(w["probability"], F.lit(1.0)).alias("probability"), F.filter(F.coalesce(w["alternatives"], F.array().cast("array<string>")), lambda a: F.trim(a) != "").alias("alternatives"))

    def one(s: Column, i: Column) -> Column:
        number = i if renumber else F.coalesce(s["id"], i)
        return F.struct(
            number.alias("seg_id"), F.round(F.coalesce(s["start"], F.lit(0.0)) * 1000).cast("long").alias("start_ms"), F.round(F.coalesce(s["end"], F.lit(0.0)) * 1000).cast("long").alias("end_ms"),
            F.coalesce(s["text"], F.lit("")).alias("text"), s["text_pl"].alias("text_pl"), F.coalesce(s["speaker"], F.lit(speaker)).alias("speaker"), F.transform(F.coalesce(s["words"], F.array().cast(f"array<{_WORD}>")), word).alias("words"),
        )

    return F.transform(segments, one)


def imported(texts: DataFrame, renumber: bool = True, speaker: str = DEFAULT_SPEAKER) -> DataFrame:
    """(recording_id, language, seg_id, start_ms, end_ms, text, text_pl, speaker, words) of ``texts`` (recording_id, json).

    A document is an array of segments or an object with ``segments``; without an array, an error row
    is what ``rejected`` gives and no segment. Ids are positions unless ``renumber`` is off.
    """
    array = F.from_json("json", f"array<{_SEGMENT}>")
    whole = F.from_json("json", f"struct<segments:array<{_SEGMENT}>,detected_language:string,language:string>")
    is_array = F.ltrim("json").startswith("[")
    rows = texts.select("recording_id", F.when(is_array, array).otherwise(whole["segments"]).alias("s"), F.when(is_array, "auto").otherwise(F.coalesce(whole["detected_language"], whole["language"], F.lit("auto"))).alias("language"))
    rows = rows.select("recording_id", "language", F.explode(parsed_segments(F.col("s"), renumber, speaker)).alias("s"))
    return rows.select("recording_id", "language", "s.*")


def rejected(texts: DataFrame) -> DataFrame:
    """(recording_id, error) of documents that hold no array of segments."""
    kind = F.try_parse_json("json")
    array = F.schema_of_variant(kind).startswith("ARRAY") | F.coalesce(F.schema_of_variant(F.try_variant_get(kind, "$.segments", "variant")).startswith("ARRAY"), F.lit(False))
    return texts.filter(~F.coalesce(array, F.lit(False))).select("recording_id", F.lit("no array of segments").alias("error"))


def read_transcripts(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Imports every JSON file below ``path``; the file's path is its recording_id."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("recording_id"), F.col("value").alias("json"))
    return imported(files, **kw)


def numbered_speakers(rows: DataFrame) -> DataFrame:
    """Labels raw speakers by first appearance and then drops blank texts: a blank row still takes a number.

    ``rows`` has recording_id, seg_id, speaker and text.
    """
    first = rows.groupBy("recording_id", "speaker").agg(F.min("seg_id").alias("first"))
    order = Window.partitionBy("recording_id").orderBy("first")
    labels = first.withColumn("label", F.format_string("GŁOS_%02d", F.row_number().over(order))).drop("first")
    return rows.join(labels, ["recording_id", "speaker"]).filter(F.trim("text") != "").select("recording_id", "seg_id", "label", "text")


def stitched_lines(chunks: DataFrame) -> DataFrame:
    """(stream, line, value) of byte chunks (stream, pos, data) that cut a stream anywhere, inside characters too.

    A chunk is cut at its line feeds. Its first piece goes on with the last piece of the chunk before, and so on: pieces of one line have one
    number, the line feeds before them in the stream, and are joined by it. What follows the last line feed is no line yet. Bytes
    that are no UTF-8 become replacement characters; an empty or null chunk changes nothing.
    """
    raw = F.decode("data", "ISO-8859-1")  # a character for each byte
    rows = chunks.filter("data is not null").select("stream", "pos", F.split(raw, "\n", -1).alias("_p")).withColumn("_n", F.size("_p") - 1)
    block = Window.partitionBy("stream", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.floor(F.col("pos") / 4096))
    before = Window.partitionBy("stream").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("stream", "_b").agg(F.sum("_n").alias("_s")).select("stream", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(block), F.lit(0))).join(bases, ["stream", "_b"])
    pieces = rows.select("stream", "pos", (F.col("_base") + F.col("_in")).alias("_at"), F.posexplode("_p").alias("_k", "_t"))
    lines = pieces.groupBy("stream", (F.col("_at") + F.col("_k")).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), "").alias("_v"))
    ended = rows.groupBy("stream").agg(F.sum("_n").alias("_ends"))
    text = F.decode(F.encode("_v", "ISO-8859-1"), "UTF-8")
    return lines.join(ended, "stream").filter(F.col("line") < F.col("_ends")).select("stream", "line", text.alias("value"))


def event_lines(lines: DataFrame) -> DataFrame:
    """(value, type) of server-sent lines that start with ``data: `` and hold JSON; others are skipped."""
    body = lines.filter(F.col("value").startswith("data: ")).select(F.expr("substring(value, 7)").alias("value"))
    return body.withColumn("j", F.try_parse_json("value")).filter("j is not null").select("value", F.try_variant_get("j", "$.type", "string").alias("type"))


def chat_text(lines: DataFrame) -> DataFrame:
    """(stream, content): the deltas of newline-delimited chat replies (stream, pos, value) in order."""
    j = F.try_parse_json("value")
    rows = lines.select("stream", "pos", F.try_variant_get(j, "$.message.content", "string").alias("c")).filter("c is not null")
    return rows.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]), "").alias("content"))


def saved_memories(memories: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """Memories (id, created, observation, importance) after saving ``new``: newest first, ``most`` at most.

    One whose first 80 characters, trimmed and in lower case, are known already is not saved again.
    """
    key = F.substring(F.lower(F.trim("observation")), 1, 80)
    rows = memories.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_key", key)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_new", "created", "id"))).filter("_n = 1")
    return rows.orderBy(F.desc("created"), F.desc("id")).limit(most).drop("_new", "_key", "_n")


def memory_prompt(memories: DataFrame, most: int = 8) -> DataFrame:
    """One row (prompt): the newest ``most`` memories as lines."""
    top = memories.orderBy(F.desc("created"), F.desc("id")).limit(most)
    line = F.concat(F.lit("- ["), "importance", F.lit("] "), "observation")
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created", "id", line.alias("line"))), asc=False), lambda s: s["line"]), "\n").alias("prompt"))


def write_export(exports: DataFrame, path: str) -> None:
    """Writes ``exports`` (recording_id, export) as text, a folder per recording."""
    exports.select("recording_id", F.col("export").alias("value")).write.partitionBy("recording_id").text(path)


def decoded_audio(files: DataFrame, rate: int = 16_000, decode=None) -> DataFrame:
    """(path, seconds, sha256, pcm) of ``files`` (path, content): mono samples in -1 to 1 at ``rate``.

    PCM WAV is read here; ``decode(bytes) -> (samples, rate)`` is the boundary for other containers.
    """

    def pcm(content: bytes) -> tuple[np.ndarray, int]:
        if decode is not None and content[:4] != b"RIFF":
            return decode(content)
        with wave.open(io.BytesIO(content)) as w:
            width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64)
        else:
            x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        return (x / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1), own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x, own = pcm(bytes(content))
                if own != rate and len(x):
                    n = round(len(x) * rate / own)
                    x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)
                out.append((path, x.astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "pcm"])

    samples = files.select("path", "content").mapInPandas(run, "path string, pcm array<float>")
    facts = files.select("path", F.sha2("content", 256).alias("sha256"))
    return samples.join(facts, "path").select("path", F.round(F.size("pcm") / rate, 1).alias("seconds"), "sha256", "pcm")


def read_audio(spark: SparkSession, path: str, **kw) -> DataFrame:
    return decoded_audio(spark.read.format("binaryFile").load(path), **kw)
