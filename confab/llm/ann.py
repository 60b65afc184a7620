"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives a vector a long string of hash bits (sides of random hyperplanes through sampled
medians). A tree is a sorted array of these strings, dealt in blocks of consecutive ones. A query
descends in every tree, by binary search, to the longest prefix it shares with others, and then ascends
in all trees at once, depth by depth, until the prefixes hold enough candidates: the searches give the
number of strings under each of its prefixes, so the depth to stop at is known without touching vectors.
The prefixes that queries stop at are cells, ranges of the arrays: there queries meet candidates, both
in bounded blocks, and each meeting returns its nearest only. Of equal vectors the smallest ids that an
answer can hold stand for all, so a vector copied a million times is no larger cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm.common import settling, table, written

TREES = 16
BITS = 48
#: Recall@k that candidates are taken for, and the queries it is measured on: 0.9 and a margin for the sample.
RECALL = 0.93
PROBES = 256
#: Rows that the hyperplanes' places are fitted on.
SAMPLE = 4_000
K = 10
#: Strings in a block of a sorted array; 2 ** -20 of the strings are therefore the places of blocks, which the driver holds.
ARRAY = 1 << 20
_CELL = 4096
_BLOCK = 2048
_PAIRS = 1 << 16


class Forest:
    """Hyperplanes of each tree: code bits of a vector, most significant first."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.bits, self.dim = trees, bits, sample.shape[1]
        self.centre = np.median(sample, axis=0)
        sample = sample - self.centre
        spread = np.sqrt(np.maximum(np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(self.dim))[0], 0)) if self.dim > 1 else np.ones(1)
        axes = np.linalg.eigh(np.cov(sample.T))[1] if len(sample) > 1 and self.dim > 1 else np.eye(self.dim)
        self.planes = axes @ (np.maximum(spread, 1e-12)[:, None] * rng.normal(size=(self.dim, trees * bits)))
        self.places = np.median(sample @ self.planes, axis=0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """An int64 of ``bits`` bits for each row and tree."""
        on = ((x - self.centre) @ self.planes > self.places).reshape(len(x), self.trees, self.bits)
        return (on.astype(np.int64) << np.arange(self.bits - 1, -1, -1)).sum(axis=2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, empty or zero and wholly finite; floats stay floats."""
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _coded(rows: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                own = batch.slice(at, _BLOCK)
                codes = forest.codes(_matrix(own.column(1), forest.dim))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * forest.trees), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists], ["id", "v", "codes"])

    return rows.mapInArrow(run, f"id long, v {dict(rows.dtypes)['v']}, codes array<long>")


def prefix_ranges(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string under each prefix of ``codes``, by depth 0 to ``bits``."""
    left = np.int64(bits) - np.arange(bits + 1)
    low = codes[:, None] >> left << left
    return low, low + (np.int64(1) << left) - 1


class Arrays:
    """The forest's sorted arrays: a written table (block, tree, code, id) and where each block's part of a tree lies."""

    def __init__(self, index: DataFrame, total: int, trees: int, bits: int, block: int = ARRAY):
        n, self.trees, self.bits = trees * total, trees, bits
        parts = max(1, -(-n // block), min(trees, -(-n // 50_000)))
        rows = index.select("id", F.posexplode("codes").alias("tree", "code")).repartitionByRange(parts, "tree", "code", "id")
        self.rows = written(rows.sortWithinPartitions("tree", "code", "id").select(F.spark_partition_id().alias("block"), "tree", "code", "id"), "arrays")
        places = self.rows.groupBy("block", "tree").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        self.places = [np.array(sorted((p["low"], p["high"], p["block"], p["n"]) for p in places if p["tree"] == t), np.int64).reshape(-1, 4) for t in range(trees)]

    def counts(self, reps: DataFrame) -> DataFrame:
        """(q, counts): how many strings of all trees share each prefix of ``reps`` (id, codes), by depth."""
        places, bits = self.places, self.bits
        ranges = lambda codes: prefix_ranges(codes, bits)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # blocks that lie under a prefix as a whole
                codes = batch.column(1).flatten().to_numpy().reshape(-1, len(places))
                total = np.zeros((len(codes), bits + 1), np.int64)
                for t, own in enumerate(places):
                    low, high = ranges(codes[:, t])
                    for a, b, _, n in own.tolist():
                        total += n * ((low <= a) & (b <= high))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * (bits + 1)), pa.array(total.ravel()))], ["q", "counts"])

        def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # blocks that some prefix ends in
                ids, codes = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, len(places))
                out = []
                for t, own in enumerate(places):
                    low, high = ranges(codes[:, t])
                    for a, b, block, _ in own.tolist():
                        at = np.flatnonzero((((low <= b) & (a <= high)) & ~((low <= a) & (b <= high))).any(axis=1))
                        if len(at):
                            out.append((np.full(len(at), block), ids[at], np.full(len(at), t), codes[at, t]))
                if out:
                    block, q, tree, code = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(q), pa.array(tree.astype(np.int32)), pa.array(code)], ["block", "q", "tree", "code"])

        def search(array: pa.Table, asked: pa.Table) -> pa.Table:
            trees, codes = array.column("tree").to_numpy(), array.column("code").to_numpy()
            q, tree, code = (asked.column(c).to_numpy() for c in ("q", "tree", "code"))
            ids, place = np.unique(q, return_inverse=True)
            total = np.zeros((len(ids), bits + 1), np.int64)
            for t in np.unique(tree):
                own, at = np.sort(codes[trees == t]), np.flatnonzero(tree == t)
                low, high = ranges(code[at])
                n = np.searchsorted(own, high, side="right") - np.searchsorted(own, low)
                np.add.at(total, place[at], np.where((low <= own[0]) & (own[-1] <= high), 0, n))
            return pa.table({"q": pa.array(ids), "counts": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (bits + 1)), pa.array(total.ravel()))})

        own = reps.select("id", "codes")
        found = self.rows.select("block", "tree", "code").groupBy("block").cogroup(own.mapInArrow(asks, "block int, q long, tree int, code long").groupBy("block")).applyInArrow(
            lambda array, asked: search(array, asked) if asked.num_rows and array.num_rows else pa.table({"q": pa.array([], pa.int64()), "counts": pa.array([], pa.list_(pa.int64()))}), "q long, counts array<long>"
        )
        both = found.unionByName(own.mapInArrow(whole, "q long, counts array<long>"))
        return both.groupBy("q").agg(F.array(*[F.sum(F.get("counts", F.lit(d))) for d in range(bits + 1)]).alias("counts"))

    def members(self, cells: DataFrame) -> DataFrame:
        """(cell, id) of the strings of each of ``cells`` (cell, tree, low, high)."""
        places = self.places

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, low, high = (batch.column(i).to_numpy() for i in (1, 2, 3))
                for t, own in enumerate(places):
                    for a, b, block, _ in own.tolist():
                        at = np.flatnonzero((tree == t) & (low <= b) & (a <= high))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int32)), *batch.take(pa.array(at)).columns], ["block", "cell", "tree", "low", "high"])

        def read(array: pa.Table, asked: pa.Table) -> pa.Table:
            trees, codes, ids = (array.column(c).to_numpy() for c in ("tree", "code", "id"))
            cell, tree, low, high = (asked.column(c).to_numpy() for c in ("cell", "tree", "low", "high"))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for t in np.unique(tree):
                own = np.flatnonzero(trees == t)
                own = own[np.argsort(codes[own], kind="stable")]
                for i in np.flatnonzero(tree == t).tolist():
                    a, b = np.searchsorted(codes[own], low[i]), np.searchsorted(codes[own], high[i], side="right")
                    out.append((np.full(b - a, cell[i]), ids[own[a:b]]))
            cells_, ids_ = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table({"cell": pa.array(cells_), "id": pa.array(ids_)})

        dealt = cells.select("cell", "tree", "low", "high").mapInArrow(deal, "block int, cell long, tree int, low long, high long")
        return self.rows.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(read, "cell long, id long")


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows from their differences, in slices, without overflow."""
    out = np.empty(len(q))
    for at in range(0, len(q), _PAIRS):
        d = q[at : at + _PAIRS] - x[at : at + _PAIRS]
        most = np.abs(d).max(axis=1, initial=0)
        odd = (most > 1e150) | ((most < 1e-150) & (most > 0))
        out[at : at + _PAIRS] = np.sqrt((d * d).sum(1)) if not odd.any() else np.where(odd, most * np.sqrt(((d / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)), np.sqrt((np.where(odd[:, None], 0, d) ** 2).sum(1)))
    return out


def near_pairs(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) that hold the ``k`` nearest of each q and all that rounding can't tell from them.

    One product of centred and scaled rows bounds the distances up to an error that their lengths give.
    """
    centre = x.mean(axis=0)
    a, b = q - centre, x - centre
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) or 1.0
    a, b = a / most, b / most
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    d = aa[:, None] + bb[None] - 2 * a @ b.T
    if len(x) <= k:
        return np.nonzero(np.ones_like(d, dtype=bool))
    error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max())
    part = np.partition(d, k - 1, axis=1)[:, k - 1]
    return np.nonzero(d <= (part + 2 * error)[:, None])


def _searched(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """The ``k`` nearest (q, id, dist) of each query and cell of ``rows`` (cell, is_query, id, v)."""

    def nearest(q_ids, q, ids, x):
        at_q, at_x = near_pairs(q, x, k)
        dist = np.concatenate([distances(q[at_q[i : i + _PAIRS]], x[at_x[i : i + _PAIRS]]) for i in range(0, len(at_q), _PAIRS)]) if len(at_q) else np.zeros(0)
        order = np.lexsort((ids[at_x], dist, at_q))
        at_q, at_x, dist = at_q[order], at_x[order], dist[order]
        begin = np.searchsorted(at_q, at_q)
        keep = np.arange(len(at_q)) - begin < k
        return pa.RecordBatch.from_arrays([pa.array(q_ids[at_q[keep]]), pa.array(ids[at_x[keep]]), pa.array(dist[keep])], ["q", "id", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, q, ids, x, held = None, [], [], [], [], 0

        def flush():
            nonlocal ids, x, held
            if held and q:
                yield nearest(np.concatenate(q_ids), np.concatenate(q), np.concatenate(ids), np.concatenate(x))
            ids, x, held = [], [], 0

        for batch in batches:
            cells = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            number, vec = batch.column(2).to_numpy(), _matrix(batch.column(3), dim)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != now:
                    yield from flush()
                    now, q_ids, q = cells[a], [], []
                if asks[a]:
                    q_ids.append(number[a:b])
                    q.append(vec[a:b])
                    continue
                for s in range(a, b, _BLOCK):
                    e = min(b, s + _BLOCK)
                    ids.append(number[s:e])
                    x.append(vec[s:e])
                    held += e - s
                    if held >= _BLOCK:
                        yield from flush()
        yield from flush()

    ordered = rows.select("cell", "is_query", "id", "v").repartition("cell").sortWithinPartitions("cell", F.desc("is_query"))
    return ordered.mapInArrow(run, "q long, id long, dist double")


def _truth(index: DataFrame, probes: list, forest: Forest, k: int) -> dict[int, list[int]]:
    """For each probe (q, id, v, codes) the longest prefix that each of its ``k`` nearest shares with it in any tree.

    One pass over ``index``; a task returns its ``k`` nearest of each probe only.
    """
    q_ids, q_rows = (np.array([p[c] for p in probes], np.int64) for c in ("id", "q"))
    q = np.array([p["v"] for p in probes], float) - forest.centre
    own = np.array([p["codes"] for p in probes], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), forest.dim) - forest.centre
                codes = part.column(2).flatten().to_numpy().reshape(-1, forest.trees)
                d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
                d[q_ids[:, None] == ids[None]] = np.inf
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(q), 1))
                for i, cols in enumerate(near):
                    cols = cols[np.isfinite(d[i, cols])]
                    shared = forest.bits - np.frexp((codes[cols] ^ own[i]).astype(float))[1].min(axis=1) if len(cols) else np.empty(0, np.int64)
                    rows = [np.concatenate(c) for c in zip(best[i], (d[i, cols], ids[cols], shared), strict=True)]
                    keep = np.lexsort((rows[1], rows[0]))[:k]
                    best[i] = tuple(r[keep] for r in rows)
        n = [len(b[0]) for b in best]
        dist, ids, shared = (np.concatenate(c) for c in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_rows, n)), pa.array(ids), pa.array(dist), pa.array(shared.astype(np.int64))], ["q", "id", "dist", "shared"])

    order = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    found = index.select("id", "v", "codes").mapInArrow(run, "q long, id long, dist double, shared long")
    out: dict[int, list[int]] = {}
    for r in found.withColumn("nth", order).filter(F.col("nth") <= k).select("q", "shared").collect():  # at most PROBES * k rows
        out.setdefault(r["q"], []).append(r["shared"])
    return out


def _enough(least: int, recall: float, sizes: dict[int, list[int]], truth: dict[int, list[int]]) -> int:
    """The fewest candidates, from ``least`` in steps of a fifth, with which the probes find ``recall`` of their neighbours.

    ``sizes`` has for each probe the candidates by depth; at depth 0 all are found.
    """
    total = sum(map(len, truth.values()))
    while total:
        found = 0
        for q, shared in truth.items():
            depth = max((d for d, n in enumerate(sizes[q]) if n >= least), default=0)
            found += sum(s >= depth for s in shared)
        if found >= recall * total:
            break
        least += max(1, least // 5)
    return least


@settling("neighbours")
def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, candidates: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, array: int = ARRAY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``, by Euclidean distance.

    ``queries`` has the columns of ``vectors`` and may be part of it; a row's own id is no answer to it. Ties
    go to the smaller id. Rows without id or without a usable vector (null, zero, not finite, or of
    another length than most) take no part; rows of one id count once, at the nearest of its vectors.
    The forest is fitted on ``SAMPLE`` rows by hash; every row is indexed. Other columns are ignored. Empty
    tables give no rows.

    A query ascends until it has ``candidates``. By default that number is measured, at any size in the same
    way: it grows until ``PROBES`` queries by hash, held against all rows, find ``recall`` of their
    neighbours, so what is looked at follows the table's size and shape.
    """
    rows = usable(vectors, id_col, vec_col)
    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
    dims = sorted(len(v) for v in sample)
    dim = dims[len(dims) // 2] if dims else 1
    forest = Forest(np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim) if dims else np.eye(1), trees)
    copies = Window.partitionBy("v").orderBy("id")
    rows = rows.filter(F.size("v") == dim).distinct().withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).drop("nth")
    index = written(_coded(rows, forest).withColumn("row", F.monotonically_increasing_id()), "index")
    asked = usable(queries, id_col, vec_col).filter(F.size("v") == dim)
    reps = _coded(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), forest)
    reps = written(reps.withColumn("q", F.monotonically_increasing_id()), "queries")
    members = asked.join(reps.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q").distinct()
    arrays = Arrays(index.select(F.col("row").alias("id"), "codes"), index.count(), trees, forest.bits, array)
    counts = written(arrays.counts(reps.select(F.col("q").alias("id"), "codes")), "counts")
    if candidates is None:
        probes = reps.orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()
        sizes = {r["q"]: r["counts"] for r in counts.filter(F.col("q").isin([p["q"] for p in probes])).collect()} if probes else {}
        candidates = _enough(4 * trees * (k + 1), recall, sizes, _truth(index, probes, forest, k)) if probes else 1
    stop = F.coalesce(F.array_max(F.transform("counts", lambda n, d: F.when(n >= candidates, d))), F.lit(0))
    left = F.expr(f"{forest.bits} - depth")
    stops = reps.select("q", F.posexplode("codes").alias("tree", "code")).join(counts.select("q", stop.alias("depth")), "q").filter("depth > 0 or tree = 0")
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("code"), left), left)
    stops = stops.select("q", "tree", F.xxhash64("tree", "depth", low).alias("cell"), low.alias("low"), (low + F.call_function("shiftleft", F.lit(1).cast("long"), left) - 1).alias("high"))
    stops = written(stops, "stops")
    cells = written(stops.groupBy("cell", "tree", "low", "high").agg(F.ceil(F.count(F.lit(1)) / _CELL).cast("int").alias("askers")), "cells")
    found = written(arrays.members(cells), "members")
    sizes = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _CELL).cast("int").alias("blocks")).join(cells.select("cell", "askers"), "cell")
    sizes = written(sizes, "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meeting = F.xxhash64("cell", "block", "asker").alias("cell")
    there = found.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("asker", every("askers"))
    there = there.select(meeting, F.col("id").alias("row")).join(index.select("row", "id", "v"), "row").select("cell", F.lit(False).alias("is_query"), "id", "v")
    asks = stops.select("q", "cell").join(sizes, "cell").withColumn("asker", F.pmod(F.xxhash64("q"), F.col("askers")).cast("int")).withColumn("block", every("blocks"))
    asks = asks.select(meeting, "q").join(reps.select("q", "v"), "q").select("cell", F.lit(True).alias("is_query"), F.col("q").alias("id"), "v")
    hits = _searched(there.unionByName(asks), dim, k + 1).groupBy("q", "id").agg(F.min("dist").alias("dist"))
    few = Window.partitionBy("q").orderBy("dist", "id")
    hits = hits.withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= k + 1)
    own = members.join(hits, "q").filter("query_id <> id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("dist").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth of all ``embeddings``; cases as in ``nearest_neighbours``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
