"""A translation checked by a model: samples are scored, poor rows are asked for again in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.models import called
from confab.operators.segments import REC, by_id
from confab.sources.storage import written

Model = Callable[[list[str]], list[str | None]]

_RATE = "Rate these translations from %s into Polish from 1 (wrong) to 5 (natural). Answer in JSON with scores and avg.\n%s"
_AGAIN = "Translate from %s into natural Polish; answer with the translation only.\n"


def batch_scores(rows: DataFrame, language: str, score: Model, every: int = 2, sample: int = 4, chars: int = 120) -> DataFrame:
    """(recording_id, batch_id, avg, low): what ``score`` makes of the first rows of every second batch.

    ``rows`` has recording_id, seg_id, batch_id, text and text_pl; ``low`` are the seg_ids scored 2 or less. A reply that is no JSON
    object is no check; one without an average counts 3. Scores beyond the sample are passed over.
    """
    nth = F.row_number().over(Window.partitionBy(REC, "batch_id").orderBy("seg_id"))
    rows = rows.filter((F.col("batch_id") + 1) % every == 0).withColumn("_n", nth).filter(F.col("_n") <= sample)
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, chars)
    line = F.concat(F.col("_n").cast("string"), F.lit(f". [{language}] "), cut("text"), F.lit("\n   [pl] "), cut("text_pl"))
    lines = F.array_sort(F.collect_list(F.struct("_n", "seg_id", line.alias("line"))))
    asked = rows.groupBy(REC, "batch_id").agg(lines.alias("_l"))
    asked = asked.select(REC, "batch_id", F.col("_l.seg_id").alias("_ids"), F.format_string(_RATE, F.lit(language), F.array_join("_l.line", "\n")).alias("prompt"))
    said = called(asked, "prompt", score).withColumn("_v", F.try_parse_json("reply"))
    said = said.filter(F.try_variant_get("_v", "$", "map<string,variant>").isNotNull())
    marks = F.coalesce(F.try_variant_get("_v", "$.scores", "array<double>"), F.array().cast("array<double>"))
    low = F.filter("_ids", lambda x, i: F.coalesce(F.get("_marks", i) <= 2, F.lit(False)))
    return said.withColumn("_marks", marks).select(REC, "batch_id", F.coalesce(F.try_variant_get("_v", "$.avg", "double"), F.lit(3.0)).alias("avg"), low.alias("low"))


def retried(rows: DataFrame, low: DataFrame, language: str, retry: Model) -> DataFrame:
    """(recording_id, seg_id, text_pl): new translations of the rows ``low`` (recording_id, seg_id), where they are taken.

    In order of rows: each is shown with two rows before and one after as they stand by then. So a row waits for a low one at most two before it:
    of a run of such rows round k asks for the k-th, of all recordings at once, and writes it. There are as many rounds as the longest run has
    rows (a sample's size, unless batches are shorter than that). A reply is taken, trimmed, if it is neither blank nor, case aside, the original.
    """
    w = by_id()
    shown = F.coalesce(F.nullif("text_pl", F.lit("")), F.nullif("text", F.lit("")))
    marked = rows.select(REC, "seg_id", "text", "text_pl").join(low.select(REC, "seg_id").distinct().withColumn("_low", F.lit(True)), [REC, "seg_id"], "left")
    at = F.row_number().over(w)
    marked = marked.withColumns({"_at": at, "_b2": F.lag(shown, 2).over(w), "_b1": F.lag(shown, 1).over(w), "_a1": F.lead(shown, 1).over(w)}).filter("_low")
    opens = F.when(F.col("_at") - F.lag("_at").over(w) <= 2, 0).otherwise(1)
    marked = marked.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w))
    level = F.row_number().over(Window.partitionBy(REC, "_run").orderBy("seg_id"))
    todo = written(marked.withColumn("_k", level).drop("_low", "_opens", "text_pl"), "low-rows")
    done = None
    for k in range(1, (todo.agg(F.max("_k")).first()[0] or 0) + 1):
        now = todo.filter(F.col("_k") == k)
        for back in (1, 2):
            if k > 1:
                new = done.filter(F.col("_k").isin(k - 1, k - 2)).select(REC, (F.col("_at") + back).alias("_at"), F.col("text_pl").alias("_new"))
                now = now.join(new, [REC, "_at"], "left").withColumn(f"_b{back}", F.coalesce("_new", f"_b{back}")).drop("_new")
        before = F.concat_ws(" / ", "_b2", "_b1")
        parts = F.concat(F.format_string(_AGAIN, F.lit(language)), F.when(before != "", F.concat(F.lit("Before: "), before, F.lit("\n"))).otherwise(""), F.lit("TRANSLATE: "), F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\nAfter: "), F.col("_a1")), F.lit("")))
        said = called(now.withColumn("prompt", parts), "prompt", retry).withColumn("text_pl", F.trim("reply"))
        said = said.withColumn("text_pl", F.when((F.col("text_pl") != "") & (F.lower("text_pl") != F.lower(F.coalesce("text", F.lit("")))), F.col("text_pl")))
        said = written(said.select(REC, "seg_id", "_at", "_k", "text_pl"), "retried")
        done = said if done is None else done.unionByName(said)
    taken = done if done is not None else rows.limit(0)
    return taken.select(REC, "seg_id", "text_pl").filter("text_pl is not null")


def checked_translation(rows: DataFrame, language: str, score: Model, retry: Model) -> tuple[DataFrame, DataFrame]:
    """Rows (recording_id, seg_id, text_pl) after poor ones were asked for again, and a report for each recording.

    The report has n_translated, n_checks, average (of the checks, two digits; null without any), n_retranslated and acceptable
    (an average of 3 or more, or none). Polish rows are their own translation; nothing is asked of rows of unknown language.
    """
    if language == "pl":
        rows = rows.withColumn("text_pl", F.col("text"))
    ask = language not in ("pl", "auto")
    checks = written(batch_scores(rows if ask else rows.limit(0), language, score), "batch-scores")
    low = checks.select(REC, F.explode("low").alias("seg_id"))
    new = retried(rows, low, language, retry).withColumnRenamed("text_pl", "_new")
    final = rows.select(REC, "seg_id", "text_pl").join(new, [REC, "seg_id"], "left").withColumn("text_pl", F.coalesce("_new", "text_pl"))
    counts = final.groupBy(REC).agg(F.count_if(F.length("text_pl") > 0).alias("n_translated"), F.count("_new").alias("n_retranslated"))
    marks = checks.groupBy(REC).agg(F.count(F.lit(1)).alias("n_checks"), F.bround(F.avg("avg"), 2).alias("average"))
    report = counts.join(marks, REC, "left").select(REC, "n_translated", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), "average", "n_retranslated", F.coalesce(F.col("average") >= 3, F.lit(True)).alias("acceptable"))
    return final.drop("_new"), report
