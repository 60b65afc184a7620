"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0 to 1. Its integral is the
source's share of the mix; targets above ``cap`` times the source's size stop there and the excess
is reshared by weight. Inverting the cumulative demand at a document's token offset in its source
gives the training position, and documents are range-sorted by position. All of it is DataFrame
expressions; offsets come from two-level prefix sums, so a hot source is dealt over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm.common import WORD, table, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Factors of a weight at times 0, 0.5 and 1: early, even and late sources. Their integral is 1.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeating_schedules(sources: DataFrame, weights=WEIGHTS, shapes=SHAPES) -> DataFrame:
    """(source, knots) for ``sources`` (source, ...) by code point, null last; weights and shapes repeat."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    factors = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in shapes]), (F.col("nth") % len(shapes) + 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    knots = F.transform(factors, lambda f, i: F.struct((i / F.lit(float(len(shapes[0]) - 1))).alias("t"), (f * F.col("weight")).alias("w")))
    return sources.select("source", nth.alias("nth")).withColumn("weight", weight).select("source", knots.alias("knots"))


def areas(knots: Column) -> Column:
    """Integral of the schedule up to each knot."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]) * (F.get(knots, i)["w"] + F.get(knots, i - 1)["w"]) / 2,
    )
    return F.concat(F.array(F.lit(0.0)), F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.aggregate(F.slice(steps, 1, i), F.lit(0.0), lambda a, x: a + x)))


def targets(sources: DataFrame, schedules: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds knots, cums, target to ``sources`` (source, source_size): water-filling below cap times the size.

    Sources are a small table: one row each, so the running sums over them need no dealing.
    """
    own = sources.join(schedules.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("cums", areas(F.col("knots")))
    own = own.withColumns({"weight": F.element_at("cums", -1), "most": cap * F.col("source_size")})
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = own.withColumn("level", left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("full", F.col("most") < F.col("level") * F.col("weight"))
    own = own.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return own.withColumn("target", target).select("source", "source_size", "knots", "cums", "target")


def _time_at(share: Column, knots: Column, cums: Column) -> Column:
    """Time at which a source has met ``share`` (0 to 1) of its demand: the inverse of its integral."""
    area = share * F.element_at(cums, -1)
    seg = F.greatest(F.lit(1), F.least(F.size(F.filter(cums, lambda c: c <= area)), F.size(knots) - 1))
    a, b = F.element_at(knots, seg), F.element_at(knots, seg + 1)
    width, rest = b["t"] - a["t"], area - F.element_at(cums, seg)
    slope = (b["w"] - a["w"]) / width
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * rest, F.lit(0.0)))
    return a["t"] + F.least(width, F.coalesce(2 * rest / F.nullif(a["w"] + root, F.lit(0.0)), F.lit(0.0)))


def curriculum(docs: DataFrame, schedules=None, share: float = 1.5, cap: float = 2.0, buckets: int = BUCKETS, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc (its ``carry`` columns, all by default), size, source_size, target, copies.

    ``copies`` holds (nth, words, position) for each time the mix takes the document; the document at
    the end of a target is taken in part, by its first words, so that each source takes exactly its
    rounded target. A null text has size 0; a null source is a source, the last; equal rows are
    separate documents; an empty table gives no rows. ``schedules`` maps (source, source_size) to
    (source, knots); by default weights 3, 1, 2 repeat.
    """
    carried = F.struct(*[F.col(c) for c in (carry or docs.columns)])
    sized = docs.select(carried.alias("doc"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col)).alias("order"), F.col(id_col).alias("tie"))
    sized = sized.withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(buckets)))
    sized = written(sized, "sized")
    per_bucket = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sources, (schedules or repeating_schedules)(sources), share, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    starts = starts.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = written(starts, "starts").withColumnsRenamed({"source": "_s", "bucket": "_b"})
    inside = Window.partitionBy("source", "bucket").orderBy("order", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).withColumn("start", F.col("base") + F.col("inner"))
    goal = F.floor(F.col("target") + 0.5)
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1)),
        lambda p: F.struct(p.alias("nth"), F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("start") - p * F.col("source_size"))).cast("long").alias("words"), (F.col("start") + p * F.col("source_size")).alias("at")),
    )
    taken = F.transform(F.filter(passes, lambda c: c["words"] > 0), lambda c: F.struct(c["nth"].alias("nth"), c["words"].alias("words"), _time_at(c["at"] / F.col("target"), F.col("knots"), F.col("cums")).alias("position")))
    return placed.select("doc", "size", "source_size", "target", taken.alias("copies"), "order")


def training_order(placed: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per copy (doc, nth, words, size, position), range-sorted by position, then a hash of the id.

    Documents without words or that the mix doesn't take have no copies and no row; repeated rows have
    copies of their own; an empty table gives no rows.
    """
    rows = placed.select("doc", "size", "order", F.explode("copies").alias("copy")).select("doc", "size", "copy.*", "order")
    parts = [partitions] if partitions else []
    return rows.repartitionByRange(*parts, "position", "order").sortWithinPartitions("position", "order").drop("order")


def mixed(docs: DataFrame, whole: bool = False, **kw) -> DataFrame:
    """``docs`` (doc_id, text, ...) as the mix takes them, in training order: repeats are rows, a part is its first words.

    With ``whole`` no document is cut: the one at the end of a source's target is taken where at least half
    of it would be, else left out. Columns are those of ``docs``; in a part, words are joined by one space and n_chars (if there) follows.
    Short rows are placed and then joined with the texts; only where rows of one id and text repeat,
    whole rows are placed.
    """
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    rows = curriculum(marked, carry=["doc_id", "_mark"], **kw)
    keys = rows.groupBy("doc").count().filter("count > 1")
    if keys.isEmpty():
        short = rows.select(F.col("doc.doc_id").alias("_id"), F.col("doc._mark").alias("_m"), "size", "order", F.explode("copies").alias("copy")).select("_id", "_m", "size", "copy.*", "order")
        short = written(short, "placed")
        text = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_x"))
        rows = text.join(short, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_m"))).select("doc", "nth", "words", "size", "position", "order")
        rows = rows.repartitionByRange("position", "order").sortWithinPartitions("position", "order")
    else:
        rows = training_order(curriculum(docs, **kw))
    if whole:
        rows = rows.filter(F.col("words") * 2 >= F.col("size")).withColumn("words", F.col("size"))
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")))
    rows = rows.withColumn("_text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("doc.text")))
    put = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[(put[c] if c in put else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents`` with what the mix takes of it, in training order; cases as in ``curriculum``."""
    placed = curriculum(table(spark, sf_dir, "documents"), carry=["doc_id"])
    words = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    rows = placed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", words.alias("taken"), F.array_min(F.transform("copies", lambda c: c["position"])).alias("position"), "order")
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), "order").sortWithinPartitions(F.col("position").asc_nulls_last(), "order").drop("order")
