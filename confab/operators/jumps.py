"""Greedy runs of rows by pointers and doubling: where each run would end if it began at a row, then which rows begin one.

Folds of the kind "close after the row that reaches a limit, begin anew" look sequential, but the end of a run that begins
at a given row follows from running sums alone. So every row gets a pointer to the beginning of the next run, and the
beginnings reached from a recording's first row are found by joins that double the jumps: logarithmically many, whatever the
length. Running sums are two-level and searches are dealt in bins, so one long recording is many tasks, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.segments import REC
from confab.sources.storage import settled, written

BLOCK = 4096


def running(rows: DataFrame, sums: dict[str, Column], order: str = "seg_id", kind=F.sum) -> DataFrame:
    """``rows`` with running totals (or maxima, by ``kind``) of ``sums`` up to each row of its recording, its own value included.

    Rows are dealt in blocks of ``order``, a number; the blocks' totals are added from a table of a row for each block.
    """
    own = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(REC, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(REC).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.groupBy(REC, "_block").agg(*[kind(c).alias(n) for n, c in sums.items()]).select(REC, "_block", *[kind(n).over(before).alias(f"_b_{n}") for n in sums])
    own = own.withColumns({n: kind(c).over(inside) for n, c in sums.items()}).join(bases, [REC, "_block"])
    both = (lambda n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0))) if kind is F.sum else (lambda n: F.greatest(n, f"_b_{n}"))
    return own.withColumns({n: both(n) for n in sums}).drop("_block", *[f"_b_{n}" for n in sums])


def indexed(segs: DataFrame, sums: dict[str, Column] | None = None) -> DataFrame:
    """``segs`` with i, a row's place in its recording from 0, and running totals of ``sums``."""
    return running(segs, {"i": F.lit(1).cast("long"), **(sums or {})}).withColumn("i", F.col("i") - 1)


def first_at_least(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (i, key, least, ...) with hit, the first place whose key is ``least`` or more; keys never fall from row to row.

    Keys and asked values meet in bins of ``width``; where a bin has no answer, the next bin that holds keys gives its first.
    """
    names = rows.columns
    bin_of = lambda c: F.floor(F.col(c) / width)
    own = rows.select(REC, bin_of("key").alias("_bin"), F.col("key").alias("_v"), F.lit(1).alias("_ask"), F.col("i").alias("_j"), *[F.lit(None).cast(t).alias(f"_r_{n}") for n, t in rows.dtypes if n != REC])
    asks = rows.select(REC, bin_of("least").alias("_bin"), F.col("least").alias("_v"), F.lit(2).alias("_ask"), F.lit(None).cast("long").alias("_j"), *[F.col(n).alias(f"_r_{n}") for n in names if n != REC])
    both = own.unionByName(asks)
    after = Window.partitionBy(REC).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)  # later bins: a growing frame is linear
    next_ = both.groupBy(REC, "_bin").agg(F.min("_j").alias("_first")).select(REC, "_bin", F.min("_first").over(after).alias("_next"))
    above = Window.partitionBy(REC, "_bin").orderBy(F.desc("_v"), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("hit", F.min("_j").over(above)).filter("_ask = 2").join(next_, [REC, "_bin"])
    return met.select(REC, *[F.col(f"_r_{n}").alias(n) for n in names if n != REC], F.coalesce("hit", "_next").alias("hit"))


def reached(pointers: DataFrame) -> DataFrame:
    """(recording_id, i): the rows reached from i = 0 along ``pointers`` (recording_id, i, to), 0 included; ``to`` is null at the end.

    After k rounds the first 2 ** k stops are marked and a jump spans 2 ** k pointers; jumps past the end go, so the last round has none.
    """

    def make() -> DataFrame:
        jumps = written(pointers.filter("to is not null").select(REC, "i", "to"), "jumps")
        marks = written(pointers.filter("i = 0").select(REC, "i").distinct(), "marks")
        while not jumps.isEmpty():
            marks = written(marks.join(jumps, [REC, "i"]).select(REC, F.col("to").alias("i")).unionByName(marks).distinct(), "marks")
            on = jumps.select(REC, F.col("i").alias("to"), F.col("to").alias("_to"))
            jumps = written(jumps.join(on, [REC, "to"]).select(REC, "i", F.col("_to").alias("to")), "jumps")
        return marks

    return settled(make, "reached")


def numbered(rows: DataFrame, begins: DataFrame, name: str) -> DataFrame:
    """``rows`` (i, ...) with the number of the run, from 0, that each is in; ``begins`` (recording_id, i) are the runs' first rows."""
    marked = rows.join(begins.withColumn("_m", F.lit(1)), [REC, "i"], "left")
    return running(marked, {name: F.coalesce("_m", F.lit(0))}, "i").withColumn(name, (F.col(name) - 1).cast("int")).drop("_m")
