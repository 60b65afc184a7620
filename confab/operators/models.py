"""Boundaries to models: a function is injected; rows are prepared and its answers checked here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.functions.text import first_json
from confab.operators.segments import REC, by_id


def called(rows: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str | None]], batch: int = 32) -> DataFrame:
    """Adds ``reply``: the model is called once for each distinct prompt, ``batch`` at a time; failures and null prompts give null.

    Replies meet their rows by a digest of the prompt, so prompts are shuffled once, not twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts, replies = pdf["prompt"].tolist(), []
            for i in range(0, len(prompts), batch):
                replies += model(prompts[i : i + batch])
            yield pd.DataFrame({"_digest": pdf["_digest"], "reply": replies})

    rows = rows.withColumn("_digest", F.sha2(F.col(prompt_col), 256))
    asked = rows.filter("_digest is not null").groupBy("_digest").agg(F.first(prompt_col).alias("prompt"))
    return rows.join(asked.mapInPandas(run, "_digest string, reply string"), "_digest", "left").drop("_digest")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32, zero_on_failure: bool = True) -> DataFrame:
    """Adds ``embedding``; a failed batch gets zero vectors, or raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                own = pdf["text"].tolist()[i : i + batch]
                try:
                    out += [list(map(float, v)) for v in embed(own)]
                except Exception:
                    if not zero_on_failure:
                        raise
                    out += [[0.0] * dim] * len(own)
            yield pdf.assign(embedding=out)

    return texts.mapInPandas(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def probe_positions(recordings: DataFrame, seconds: float = 60.0) -> DataFrame:
    """(recording_id, at, length) of fragments to listen to, by duration: three, two or one."""
    d = F.least(F.lit(seconds), F.lit(90.0))
    n = F.col("duration")
    at = F.when(n > 3 * d, F.array(F.greatest(F.lit(30.0), 0.15 * n), 0.5 * n, 0.8 * n)).when(n > 1.5 * d, F.array(F.greatest(F.lit(10.0), 0.2 * n), 0.65 * n)).otherwise(F.array(F.least(F.lit(30.0), 0.2 * n)))
    return recordings.select(REC, F.explode(at).alias("at"), d.alias("length"))


def probe_summary(probes: DataFrame) -> DataFrame:
    """(recording_id, confidence, language, suggestion) of probes (recording_id, pos, confidence, language)."""
    votes = probes.groupBy(REC, "language").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = votes.groupBy(REC).agg(F.max_by("language", F.struct(F.col("n"), -F.col("first"))).alias("language"))
    mean = probes.groupBy(REC).agg(F.avg("confidence").alias("confidence"))
    said = F.when(F.col("confidence") < 0.6, "large").when(F.col("confidence") < 0.75, "context").otherwise("none")
    return mean.join(best, REC, "left").select(REC, F.round("confidence", 4).alias("confidence"), "language", said.alias("suggestion"))


def better_candidate(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The candidate of higher confidence of each key; on a tie the preferred one (``preferred`` true)."""
    own = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.max_by(F.struct(*own), F.struct("confidence", "preferred")).alias("c")).select(*key, "c.*")


def multi_pass(turns: DataFrame, unsure: float = 0.3, short_ms: int = 800) -> DataFrame:
    """(key, text, confidence, kept) of turns heard twice (key, dur_ms, a_text, a_conf, b_text, b_conf) and, with c_text and c_conf, in a wider window.

    Only turns below ``short_ms`` are arbitrated, where both hearings have text and their words differ (Jaccard below 0.4): the surer
    one is taken; if both are below ``unsure`` and the turn below 0.5 s, it goes. What is then below 0.45 in a turn below 3 s takes the
    wider hearing if that is surer. A turn without text goes.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    a, b = words(F.col("a_text")), words(F.col("b_text"))
    differ = F.size(F.array_intersect(a, b)) < 0.4 * F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    judged = (F.col("dur_ms") < short_ms) & ~blank(F.col("a_text")) & ~blank(F.col("b_text")) & (F.col("a_text") != F.col("b_text")) & differ
    second = judged & (F.col("b_conf") > F.col("a_conf"))
    gone = judged & (F.greatest("a_conf", "b_conf") < unsure) & (F.col("dur_ms") < 500)
    wide = [F.col(c) if c in turns.columns else F.lit(None) for c in ("c_text", "c_conf")]
    rows = turns.select("key", "dur_ms", F.when(second, F.col("b_text")).otherwise(F.col("a_text")).alias("text"), F.when(second, F.col("b_conf")).otherwise(F.col("a_conf")).alias("confidence"), F.coalesce(gone, F.lit(False)).alias("_gone"), wide[0].cast("string").alias("c_text"), wide[1].cast("double").alias("c_conf"))
    surer = F.coalesce(~blank(F.col("text")) & (F.col("confidence") < 0.45) & (F.col("dur_ms") < 3000) & ~blank(F.col("c_text")) & (F.col("c_conf") > F.col("confidence")), F.lit(False))
    return rows.select("key", F.when(surer, F.col("c_text")).otherwise(F.col("text")).alias("text"), F.when(surer, F.col("c_conf")).otherwise(F.col("confidence")).alias("confidence"), (~F.col("_gone") & ~blank(F.col("text"))).alias("kept"))


def ambiguous(segs: DataFrame, below_ms: int = 800, reach: int = 2, most: int = 8) -> DataFrame:
    """(recording_id, seg_id, context): short segments to ask a model about, where a recording has 1 to ``most``."""
    line = F.concat_ws(": ", "speaker", "text")
    rows = segs.withColumn("context", F.array_join(F.collect_list(line).over(by_id().rowsBetween(-reach, reach)), "\n"))
    rows = rows.filter((F.col("end_ms") - F.col("start_ms") < below_ms) & (F.trim("text") != ""))
    n = F.count(F.lit(1)).over(Window.partitionBy(REC))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).select(REC, "seg_id", "context")


def accepted_speakers(answers: DataFrame, segs: DataFrame) -> DataFrame:
    """Answers (recording_id, seg_id, speaker) that name a speaker of the recording."""
    return answers.join(segs.select(REC, "speaker").distinct(), [REC, "speaker"], "left_semi")


def named_speakers(replies: DataFrame) -> DataFrame:
    """(recording_id, speaker, name): names from the first flat JSON object of a reply; null-like ones are dropped."""
    names = F.from_json(first_json(F.col("reply"), greedy=False), "map<string,string>")
    rows = replies.select(REC, F.explode(names).alias("speaker", "name")).withColumn("name", F.trim("name"))
    return rows.filter(~F.lower("name").isin("", "imię lub null", "null", "brak", "nieznany", "unknown"))


def retry_contexts(rows: DataFrame) -> DataFrame:
    """Translations scored 2 or less (recording_id, seg_id, text, text_pl, score) with two rows before and one after.

    The rows around are shown as they are translated, where they are; the row itself is the original.
    """
    shown, w = F.coalesce(F.nullif("text_pl", F.lit("")), F.nullif("text", F.lit(""))), by_id()
    context = F.concat_ws("\n", F.lag(shown, 2).over(w), F.lag(shown, 1).over(w), "text", F.lead(shown, 1).over(w))
    return rows.withColumn("context", context).filter("score <= 2").select(REC, "seg_id", "context")


def applied_retries(rows: DataFrame, retries: DataFrame) -> DataFrame:
    """``rows`` with retried translations (recording_id, seg_id, retry), trimmed, where they are neither blank nor, case aside, the original."""
    good = retries.withColumn("retry", F.trim("retry")).filter("retry <> ''").select(REC, "seg_id", "retry")
    rows = rows.join(good, [REC, "seg_id"], "left")
    return rows.withColumn("text_pl", F.when(F.lower("retry") != F.lower("text"), F.col("retry")).otherwise(F.col("text_pl"))).drop("retry")



def guarded_merges(pairs: DataFrame, least: float = 0.99) -> DataFrame:
    """(recording_id, removed, kept) of similar speakers; none where every pair of a recording is above ``least``.

    ``pairs`` has recording_id, a, b, cosine, conflict, overlap, talk_a, talk_b; the longer talker stays.
    """
    lowest = F.min("cosine").over(Window.partitionBy(REC))
    rows = pairs.withColumn("_low", lowest).filter((F.col("_low") <= 0.99) & (F.col("cosine") >= max(least, 0.99)) & ~F.col("conflict") & ~F.col("overlap"))
    keep_a = F.col("talk_a") >= F.col("talk_b")
    rows = rows.select(REC, "a", "b", F.when(keep_a, F.col("b")).otherwise(F.col("a")).alias("removed"), F.when(keep_a, F.col("a")).otherwise(F.col("b")).alias("kept"))
    return rows.groupBy(REC, "removed").agg(F.max_by("kept", F.struct("a", "b")).alias("kept"))


def profile_conflict(a: dict, b: dict):
    """Whether two profiles can't be one person: genders differ and both are sure, or ages are over 15 apart."""
    gender = (a["gender"] != b["gender"]) & (a["confidence"] > 0.7) & (b["confidence"] > 0.7)
    age = (F.coalesce(a["age"], F.lit(0)) != 0) & (F.coalesce(b["age"], F.lit(0)) != 0) & (F.abs(a["age"] - b["age"]) > 15)
    return F.coalesce(gender, F.lit(False)) | F.coalesce(age, F.lit(False))
