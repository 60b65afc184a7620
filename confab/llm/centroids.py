"""Centroid clustering with Drake's adaptive bounds, exact in whole numbers.

A vector carries its centroid, its next nearest centroids in order with a lower bound of the distance to
each and to all after it, and one bound for the remainder. When centroids move, each bound
gives way by its own centroid's move and the remainder's by the largest. The first bound above the
distance to the own centroid certifies the order beyond it: only the centroids before it are measured. Where
no bound does, all are measured and the order is taken anew. How many are kept adapts, between an
eighth and a quarter of the centroids, to the most that a round needed. Distances that decide are sums
of squares of whole numbers, without rounding, so the result is that of measuring everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm.common import table, written
from confab.sources.storage import deleted

K = 40
ROUNDS = 5
DIM = 64
SCALE = 256
#: Components beyond it are refused: squared distances of 64 of them would not fit a long.
LARGEST = 1 << 27
_BLOCK = 4096
#: Share by which bounds give way to the rounding of square roots and sums.
_SLACK = 1e-9


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<int>): floor(scale * component) of the vectors with exactly ``dim`` components, all finite."""
    whole = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v")).filter((F.size("_v") == dim) & whole)
    large = F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}"))
    return own.select("vec_id", F.transform("_v", lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(large).cast("int")).alias("x"))


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all ``centres``, exactly; int64."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # every sum below is a whole number that a double holds
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def _own_squares(x: np.ndarray, centres: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own columns of centres ``at`` (rows, some)."""
    return np.stack([((x - centres[at[:, j]]) ** 2).sum(1) for j in range(at.shape[1])], axis=1)


@dataclass
class Bounds:
    """Of each vector: its centroid and squared distance, the next centroids in order, their bounds, the remainder's bound, centroids measured."""

    own: np.ndarray
    square: np.ndarray
    next: np.ndarray
    low: np.ndarray
    rest: np.ndarray
    measured: np.ndarray


def _falling(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Each bound lowered to those after it, so that it holds for all from its place on."""
    both = np.concatenate([low, rest[:, None]], axis=1)
    return np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1]


def scan(x: np.ndarray, centres: np.ndarray, keep: int) -> Bounds:
    """All centroids measured and put in order; ties to the smaller number."""
    square = squares(x, centres)
    order = np.argsort(square, axis=1, kind="stable")
    keep = min(keep, len(centres) - 1)
    low = np.sqrt(np.take_along_axis(square, order[:, 1 : keep + 2], axis=1)) * (1 - _SLACK)
    rest = low[:, keep] if low.shape[1] > keep else np.full(len(x), np.inf)
    own = order[:, 0]
    return Bounds(own, square[np.arange(len(x)), own], order[:, 1 : keep + 1], low[:, :keep], rest, np.full(len(x), len(centres)))


def moved(x: np.ndarray, old: Bounds, centres: np.ndarray, drift: np.ndarray, keep: int) -> Bounds:
    """The bounds after centroids moved by ``drift`` at most to ``centres``, with ``keep`` or fewer of them kept."""
    keep = min(keep, old.next.shape[1])
    bound = _falling(old.low - drift[old.next], old.rest - drift.max())
    following, low, rest = old.next[:, :keep].copy(), bound[:, :keep].copy(), bound[:, keep].copy()
    bound = bound[:, : keep + 1]
    own, square = old.own.copy(), _own_squares(x, centres, old.own[:, None])[:, 0]
    above = np.sqrt(square)[:, None] * (1 + _SLACK) < bound
    needed = np.where(above.any(axis=1), above.argmax(axis=1), -1)
    measured = np.where(needed < 0, len(centres), needed + 1)
    for n in np.unique(needed).tolist():
        rows = np.flatnonzero(needed == n)
        if n < 0:
            new = scan(x[rows], centres, keep)
            own[rows], square[rows], following[rows], low[rows], rest[rows] = new.own, new.square, new.next, new.low, new.rest
        elif n > 0:
            near = np.concatenate([own[rows, None], following[rows, :n]], axis=1)
            there = np.concatenate([square[rows, None], _own_squares(x[rows], centres, near[:, 1:])], axis=1)
            order = np.lexsort((near, there), axis=1)
            near, there = np.take_along_axis(near, order, axis=1), np.take_along_axis(there, order, axis=1)
            own[rows], square[rows] = near[:, 0], there[:, 0]
            following[rows, :n], low[rows, :n] = near[:, 1:], np.sqrt(there[:, 1:]) * (1 - _SLACK)
    return Bounds(own, square, following, low, rest, measured)


_STATE = ("cluster int", "distance long", "next array<int>", "low array<double>", "rest double", "measured int")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _assigned(state: DataFrame, centres: np.ndarray, keep: int, drift: np.ndarray | None) -> DataFrame:
    """A round over ``state`` (vec_id, x, and bounds unless it is the first); rows stay where they are, nothing is shuffled."""
    id_type, dim = state.schema["vec_id"].dataType.simpleString(), centres.shape[1]
    names = ["vec_id", "x", *(f.split()[0] for f in _STATE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy().reshape(n, dim).astype(np.int64)
                if drift is None:
                    new = scan(x, centres, keep)
                else:
                    matrix = lambda i: (v := batch.column(i).flatten().to_numpy()).reshape(n, len(v) // n)  # noqa: E731, B023
                    old = Bounds(batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(4), matrix(5), batch.column(6).to_numpy(), batch.column(7).to_numpy())
                    new = moved(x, old, centres, drift, keep)
                out = [pa.array(new.own, pa.int32()), pa.array(new.square), _lists(new.next, pa.int32()), _lists(new.low, pa.float64()), pa.array(new.rest), pa.array(new.measured, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names)

    return state.mapInArrow(run, ", ".join([f"vec_id {id_type}", "x array<int>", *_STATE]))


@dataclass
class Clustering:
    """``rows`` (vec_id, x, cluster, distance, ...), the final centroids, and the distances measured in each round."""

    rows: DataFrame
    centres: np.ndarray
    measured: list[int]
    inertia: dict[int, int]


def first_centres(points: DataFrame, k: int, prefix: Column) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``prefix`` and id; rows without id are last, rows of one id by components."""
    rows = points.select("x", F.sha2(F.concat(prefix, F.col("vec_id").cast("string")), 256).alias("_h")).orderBy(F.col("_h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def clustered(points: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = "2:") -> Clustering:
    """Lloyd's algorithm over ``points`` (vec_id, x) from hashed starts, for ``rounds`` rounds and a last assignment.

    Ties go to the smaller centroid, means are exact and rounded down, a centroid without vectors stays. Fewer
    vectors than ``k`` give as many centroids, no vectors no rows. Rows that repeat count
    each. The state of a round is a written table; the one before it is deleted. The driver holds
    the centroids only: ``k`` vectors.
    """
    centres = first_centres(points, k, F.lit(seed))
    n, keep, drift, measured = len(centres), -(-k // 4), None, []
    if not n:
        empty = points.withColumns({f.split()[0]: F.lit(None).cast(f.split()[1]) for f in _STATE})
        return Clustering(empty, centres, [], {})
    state = points
    for nth in range(rounds + 1):
        before, state = state, written(_assigned(state, centres, keep, drift), "clusters")
        if nth:
            deleted(before)
        found = state.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"), F.sum("measured").alias("measured"), F.max(F.when(F.col("measured") < n, F.col("measured") - 1)).alias("needed"), F.array(*[F.sum(F.get("x", F.lit(i)).cast("long")) for i in range(centres.shape[1])]).alias("sums")
        ).collect()  # a row for each centroid at most
        measured.append(sum(r["measured"] for r in found))
        if nth == rounds:
            break
        new = centres.copy()
        for r in found:
            new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        drift = np.sqrt(((new - centres) ** 2).sum(1)) * (1 + _SLACK)
        if nth:
            keep = max(-(-k // 8), min(keep, max((r["needed"] or 0 for r in found), default=0)))
        centres = new
    return Clustering(state, centres, measured, {r["cluster"]: r["inertia"] for r in found})


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of ``embeddings`` that takes part (see ``quantised``); cases as in ``clustered``.

    Vectors null, of another length or with a component null or not finite have no row. A component that is
    too large for the distance to be a long is an error.
    """
    found = clustered(quantised(table(spark, sf_dir, "embeddings")))
    total = sum(found.inertia.values())
    rows = [(c, v, total, hashlib.sha256(",".join(map(str, found.centres[c].tolist())).encode()).hexdigest()) for c, v in sorted(found.inertia.items())]
    kinds = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return found.rows.select("vec_id", "cluster", "distance").join(F.broadcast(spark.createDataFrame(rows, kinds)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
