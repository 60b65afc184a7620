"""Importance resampling towards a target distribution: bucketed n-gram weights, sorted runs, tournament merges.

Every feature (a run of one to three words) falls into one of ``BUCKETS`` buckets by its CRC-32. Two
arrays of bucket counts, of the corpus and of the target, give an array of gains, and a document's weight
is the sum of its features' gains: gathers in arrays, no joins. A weight with Gumbel noise of the id is a score,
and the highest scores are a draw without replacement. Each partition sorts its eligible rows into a run,
written to the shared folder. Splitters cut all runs into ranges of scores; counts say which ranges the draw reaches, and only
those slices move. A range's slices meet in a task and are merged by k-way tournament trees, at most
``FAN`` at a time, and the merge that reaches the exact draw count stops there. Ranks are the ranges' counts
before and the order of the merge.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import settled, table, written
from confab.llm.textkernel import flat, pieces, tidy

BUCKETS = 10_000
GRAMS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
FAN = 32
#: Keys that splitters are taken from, at any size; the driver holds them.
SAMPLE = 20_000
#: Rows that a range is meant to hold; where 4,096 ranges do not reach, more.
RANGE = 4096
RANGES = 4096
_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- CRC-32 of words and of runs of words, over arrays


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _byte_table()


def _after_zeros(most: int) -> np.ndarray:
    """[n, k, byte]: what a register with ``byte`` in its k-th place becomes after n zero bytes, n from 0 to ``most``."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = _CRC[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


_SHORT = 64
_SHIFT = _after_zeros(_SHORT).ravel()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that bytes of CRC ``crc`` have in the CRC of themselves and ``n`` bytes more."""
    out, left = crc, n
    while True:
        step = np.minimum(left, _SHORT)
        base = step * 1024
        out = _SHIFT[base + (out & 0xFF)] ^ _SHIFT[base + 256 + ((out >> 8) & 0xFF)] ^ _SHIFT[base + 512 + ((out >> 16) & 0xFF)] ^ _SHIFT[base + 768 + (out >> 24)]
        left = left - step
        if not left.any():
            return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of lower-cased ``data``."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
    at, live, n = starts[order], out.copy(), np.minimum(size, _SHORT)[order]
    for i in range(int(n.max(initial=0))):
        many = int(np.searchsorted(-n, -i, side="left"))  # words longer than i are the first
        part = live[:many]
        live[:many] = _CRC[(part ^ data[at[:many] + i]) & 0xFF] ^ (part >> 8)
    out[order] = live
    out ^= np.uint32(0xFFFFFFFF)
    for w in np.flatnonzero(size > _SHORT).tolist():
        out[w] = zlib.crc32(data[starts[w] : ends[w]])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total): runs of letters, digits and bytes of other characters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid, edge = _LETTER[data], np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def feature_buckets(data: np.ndarray, offsets: np.ndarray, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each row, for each length of run: buckets of all runs and first run of each row and the total)."""
    data = _LOWER[data]
    starts, ends, first = words_of(data, offsets)
    n, size = np.diff(first), ends - starts
    crc = word_crcs(data, starts, ends)
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
    row = np.repeat(np.arange(len(n)), n)
    out, run = [], crc
    for k in range(1, grams + 1):
        if k > 1:
            run = shifted(run[: len(crc) - k + 1], size[k - 1 :] + 1) ^ spaced[k - 1 :] if len(crc) >= k else run[:0]
        inside = row[k - 1 :] == row[: max(0, len(row) - k + 1)]
        own = run if k == 1 else run[inside]
        where = np.concatenate([[0], np.cumsum(np.maximum(0, n - k + 1))])
        out.append(((own % np.uint32(buckets)).astype(np.int64), where))
    return n, out


# -- counts and weights


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one array's worth of counts; the driver gets ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in pieces(offsets, _BYTES):
                for own, _ in feature_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets=buckets)[1]:
                    total += np.bincount(own, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])
        tidy()

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, rounded down."""
    a, b, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (a + n) / ((s + 1) * (b + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), a row per row of ``docs``; a null id is hashed as an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets, _BYTES):
                n, found = feature_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets=len(gain))
                features, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for own, where in found:
                    total = np.concatenate([[0], np.cumsum(gain[own])])
                    features += np.diff(where)
                    weight += total[where[1:]] - total[where[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        tidy()

    own = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return own.withColumn("score", (F.col("weight") + noise).cast("long"))


# -- the draw


class Tournament:
    """Merges sorted runs by a tree of losers: ``take`` gives the run whose head is smallest, then that run moves on.

    A run is a list of keys; an ended run loses against all.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at, n = runs, [0] * len(runs), len(runs)
        self.size = 1 << max(0, n - 1).bit_length()
        self.tree = [0] * self.size
        winners = [*[None] * self.size, *range(n), *[None] * (self.size - n)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1]

    def _before(self, a: int | None, b: int | None) -> bool:
        if b is None or self.at[b] >= len(self.runs[b]):
            return True
        if a is None or self.at[a] >= len(self.runs[a]):
            return False
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def take(self) -> int | None:
        """The number of the run that wins; None once all have ended."""
        run = self.top
        if run is None or self.at[run] >= len(self.runs[run]):
            return None
        self.at[run] += 1
        node, winner = (run + self.size) >> 1, run
        while node:
            if not self._before(winner, self.tree[node]):
                winner, self.tree[node] = self.tree[node], winner
            node >>= 1
        self.top = winner
        return run


def merged(runs: list[list], most: int | None = None, fan: int = FAN) -> list:
    """All ``runs`` in one order, by trees of at most ``fan`` runs, level by level; the last stops after ``most`` keys."""
    while len(runs) > fan:
        runs = [merged(runs[i : i + fan], most, fan) for i in range(0, len(runs), fan)]
    tree, out = Tournament(runs), []
    while (most is None or len(out) < most) and (run := tree.take()) is not None:
        out.append(runs[run][tree.at[run] - 1])
    return out


def _order() -> list:
    return [F.desc("score"), F.col("doc_id").asc_nulls_last()]


def _marks(eligible: DataFrame, share: float, rows: float, aim: int) -> list[tuple]:
    """Keys (score, id, run), highest first, that cut the highest ``share`` of ``eligible`` (about ``rows``) into ranges; RANGES at most.

    They only balance tasks, any keys give the same draw: taken from a sample of SAMPLE rows or so, which the driver holds.
    """
    low = eligible.select(F.percentile_approx("score", max(0.0, 1 - share), 1000)).first()[0]
    chance = min(1.0, SAMPLE / 2 / max(rows, 1))
    keys = eligible.filter((F.col("score") >= low) & (F.rand(7) < chance)).select("score", "doc_id", "_run").orderBy(*_order(), "_run").limit(SAMPLE).collect()
    ranges = max(1, min(RANGES, int(rows / aim)))
    return list(dict.fromkeys((k["score"], k["doc_id"], k["_run"]) for k in (keys[max(0, -(-i * len(keys) // ranges) - 1)] for i in range(1, ranges + 1)))) if keys else []


def range_numbers(score: np.ndarray, ids: list, run: np.ndarray, marks: list[tuple]) -> np.ndarray:
    """How many of ``marks`` stand before each row's key: by score, among equal scores by id and run."""
    falling = -np.array([m[0] for m in marks], np.int64)
    low, high = np.searchsorted(falling, -score, side="left"), np.searchsorted(falling, -score, side="right")
    place = lambda d, r: (d is None, 0 if d is None else d, r)
    for i in np.flatnonzero(low < high).tolist():
        own = place(ids[i], run[i])
        low[i] += sum(place(d, r) < own for _, d, r in marks[low[i] : high[i]])
    return low


def _ranged(runs: DataFrame, marks: list[tuple], least_words: int) -> DataFrame:
    """``runs`` with _r, the row's range; null for rows that are not eligible."""
    names = [*runs.columns, "_r"]
    where = {c: i for i, c in enumerate(runs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, n = batch.column(where["score"]).to_numpy(), batch.column(where["n_words"]).to_numpy()
            r = range_numbers(score, batch.column(where["doc_id"]).to_pylist() if marks else [], batch.column(where["_run"]).to_numpy(), marks) if marks else np.zeros(len(score), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r.astype(np.int32), mask=n < least_words)], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields]
    return written(runs.mapInArrow(run, ", ".join([*kinds, "_r int"])), "ranges")


def _edges(score: np.ndarray, run: np.ndarray, part: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Where a new slice begins: another run or range, or a row that stands before the one above it."""
    if not len(score):
        return np.zeros(1, np.int64)
    new = (run[1:] != run[:-1]) | (part[1:] != part[:-1]) | (score[1:] > score[:-1])
    for i in np.flatnonzero(~new & (score[1:] == score[:-1])).tolist():
        a, b = ids[i].as_py(), ids[i + 1].as_py()
        new[i] = a is None and b is not None or (a is not None and b is not None and b < a)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(score)]])


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, fan: int = FAN, aim: int = RANGE) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...) with rank: 1, 2, ... for the draw, null for all others.

    Of the N rows with ``least_words`` words, floor(percent * N / 100) with the highest scores are drawn; ties go to the smaller
    id, a null id is last; rows equal in both are drawn one by one, in any order. Rows that no range of the draw holds go on
    as they are; an empty table gives no rows.
    """
    fields = scored.columns
    runs = written(scored.withColumn("_run", F.spark_partition_id()).sortWithinPartitions((F.col("n_words") >= least_words).desc(), *_order()), "runs")
    eligible = runs.filter(F.col("n_words") >= least_words)
    total = eligible.count()
    draw = total * percent // 100
    if not draw:
        return runs.select(*fields).withColumn("rank", F.lit(None).cast("long"))
    share = 1.25 * draw / total
    while True:
        marks = _marks(eligible, share, share * total, aim)
        ranged = _ranged(runs, marks, least_words)
        counts = np.zeros(len(marks) + 1, np.int64)
        for r in ranged.filter("_r is not null").groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect():  # RANGES + 1 rows at most
            counts[r["_r"]] = r["n"]
        before = np.cumsum(counts) - counts
        if before[-1] >= draw or share >= 1:
            break
        share *= 4  # the marks end above the draw's end
    reached = int(np.searchsorted(before, draw, side="left"))  # ranges that begin inside the draw
    outside = F.col("_r").isNull() | (F.col("_r") >= reached)
    row = scored.schema.simpleString()
    where = {c: i for i, c in enumerate(ranged.columns)}

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of one run and range, in order, as one row."""
        for batch in batches:
            part = batch.column(where["_r"]).to_numpy()
            edges = _edges(batch.column(where["score"]).to_numpy(), batch.column(where["_run"]).to_numpy(), part, batch.column(where["doc_id"]))
            rows = pa.StructArray.from_arrays([batch.column(where[c]) for c in fields], fields)
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), rows)], ["_r", "slice"]) if len(part) else pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.list_(rows.type))], ["_r", "slice"])

    def merge(table_: pa.Table) -> pa.Table:
        r, lists = table_["_r"][0].as_py(), table_["slice"].combine_chunks()
        rows = lists.flatten()
        score, ids = rows.field("score").to_pylist(), rows.field("doc_id").to_pylist()
        keys = [(-s, d is None, 0 if d is None else d, i) for i, (s, d) in enumerate(zip(score, ids, strict=True))]
        ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
        first = merged([keys[a:b] for a, b in zip([0, *ends], ends, strict=False)], int(min(draw - before[r], counts[r])), fan)
        at = np.array([k[-1] for k in first], np.int64)
        rank = np.zeros(len(keys), np.int64)
        rank[at] = before[r] + 1 + np.arange(len(at))
        return pa.table([*rows.flatten(), pa.array(rank, mask=rank == 0)], [*fields, "rank"])

    cut = ranged.filter(~outside).mapInArrow(slices, f"_r int, slice array<{row}>")
    won = cut.repartition(max(1, reached), "_r").groupBy("_r").applyInArrow(merge, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields), "rank long"]))
    return won.unionByName(ranged.filter(outside).select(*fields, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``: drawn towards ``benchmark``; cases as in ``weighted`` and ``drawn``. A null text has no features."""

    def make() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark")))
        return drawn(weighted(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")

    return settled(make, "drawn")
