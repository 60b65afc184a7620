"""Sequential label changes, split where no earlier change can reach.

A row takes a label from its neighbours, those on its left already changed. Only rows that may change at all matter to
those after them, and only within their reach. So the rows that may change fall into chains: where the next of them is further
than the reach, a new chain begins. Every such row carries the labels around it as they were, and chains are dealt
over the cluster, each in order; all other rows stay where they are. One recording is many chains.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.operators.jumps import indexed, running
from confab.operators.segments import REC


def changed_in_order(rows: DataFrame, may_change: Column, reach: int, decide: Callable[[list, list, str], str]) -> DataFrame:
    """(recording_id, seg_id, speaker, changed): ``decide(labels before, labels after, own)`` in order for the rows that ``may_change``.

    Up to ``reach`` labels stand on either side, nearest last before and first after. ``may_change`` may use i, the row's place, and
    ``_left`` and ``_right``, the labels around as they were.
    """
    around = lambda a, b: F.collect_list(F.struct("speaker")).over(Window.partitionBy(REC).orderBy("i").rowsBetween(a, b))["speaker"]
    own = indexed(rows).withColumns({"_left": around(-reach, -1), "_right": around(1, reach)})
    asked = own.filter(may_change).select(REC, "seg_id", "i", "speaker", "_left", "_right")
    gap = F.col("i") - F.lag("i").over(Window.partitionBy(REC).orderBy("i"))
    chains = running(asked.withColumn("_new", F.when(gap <= reach, 0).otherwise(1)), {"_chain": F.col("_new")}, "i")
    chains = chains.select(REC, "_chain", "i", "seg_id", "speaker", "_left", "_right").repartition(REC, "_chain").sortWithinPartitions(REC, "_chain", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, deque()
        for batch in batches:
            out = []
            for rec, chain, i, speaker, left, right in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)), strict=True):
                if (rec, chain) != now:
                    now = rec, chain
                    recent.clear()
                while recent and i - recent[0][0] > reach:
                    recent.popleft()
                for p, label in recent:
                    left[p - i] = label  # counted from the end: the row before is the last
                new = decide(left, right, speaker)
                if new != speaker:
                    recent.append((i, new))
                out.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.string())], [REC, "seg_id", "_new"])

    new = chains.mapInArrow(run, f"{REC} {dict(rows.dtypes)[REC]}, seg_id {dict(rows.dtypes)['seg_id']}, _new string").withColumn("_was", F.lit(True))
    label = F.when(F.col("_was"), F.col("_new")).otherwise(F.col("speaker"))
    return rows.join(new, [REC, "seg_id"], "left").select(REC, F.col("seg_id").cast("int").alias("seg_id"), label.alias("speaker"), (~label.eqNullSafe(F.col("speaker"))).alias("changed"))


def neighbour_vote(segs: DataFrame, reach: int = 3, below_ms: int = 1000, other: bool = False) -> DataFrame:
    """Segments shorter than ``below_ms`` take the majority of their neighbours, left ones already changed; ties to the first seen."""

    def decide(left: list, right: list, own: str) -> str:
        near = left + right
        if not near:
            return own
        winner, n = Counter(near).most_common(1)[0]
        return winner if n >= max(2, len(near) // 2) and (winner != own or not other) else own

    return changed_in_order(segs.select(REC, "seg_id", "speaker", "start_ms", "end_ms"), F.col("end_ms") - F.col("start_ms") < below_ms, reach, decide)


def refined_vote(segs: DataFrame) -> DataFrame:
    return neighbour_vote(segs, 4, 1500, True)


def bridges(segs: DataFrame, gap_ms: int = 500) -> DataFrame:
    """A segment between two of one other speaker, both gaps below ``gap_ms``, becomes theirs; in order."""
    order = Window.partitionBy(REC).orderBy("seg_id")
    rows = segs.select(REC, "seg_id", "speaker", "start_ms", "end_ms")
    near = (F.col("start_ms") - F.lag("end_ms").over(order) < gap_ms) & (F.lead("start_ms").over(order) - F.col("end_ms") < gap_ms)
    differs = F.col("_near") & ~F.get("_right", F.lit(0)).eqNullSafe(F.col("speaker"))
    return changed_in_order(rows.withColumn("_near", F.coalesce(near, F.lit(False))), differs, 1, lambda left, right, own: left[0] if left[0] == right[0] else own)
