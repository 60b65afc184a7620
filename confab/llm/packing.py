"""Packing token sequences into windows by non-negative least squares over shallow length combinations.

Documents are encoded, closed by an end token and cut into whole windows and a rest. The rests' lengths
make a histogram, all that the driver sees: a few thousand numbers at any size. Combinations of at most
three length classes that fill a window are enumerated, repeat counts are solved against the histogram by
non-negative least squares, rounded down, and turned into combinations of exact lengths. What is left is packed
greedily on the histogram, largest first. Combinations that would leave more than ``WASTE`` of a
window empty are laid end to end instead and cut at the window's borders, the last of them at powers of two. A rest's
place follows from its length and its number among the rests of that length, by a search
in the plan, so no document meets another and nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm import wordids
from confab.llm.common import settled, table, written
from confab.llm.textkernel import tidy

WINDOW = 2048
END = 1
#: Lengths of one class for the combinations: a window has WINDOW / CLASS of them.
CLASS = 8
DEPTH = 3
#: Tokens of a window that a combination may leave empty.
WASTE = 16
#: Cut rests that are looked up by a broadcast; more are joined.
FEW = 20_000
BATCH_BYTES = 4 << 20


# -- the plan, on the driver: lengths and counts only


def combinations(parts: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Classes, largest first, of ``depth`` pieces at most that add up to ``parts``."""
    out = [(parts,)] if depth else []
    if depth > 1:
        for least in range(1, parts // 2 + 1):
            for rest in combinations_above(parts - least, depth - 1, least):
                out.append((*rest, least))
    return out


def combinations_above(parts: int, depth: int, least: int) -> list[tuple[int, ...]]:
    """Those whose smallest class is at least ``least``."""
    out = [(parts,)] if parts >= least else []
    if depth > 1:
        for low in range(least, parts // 2 + 1):
            out += [(*rest, low) for rest in combinations_above(parts - low, depth - 1, low)]
    return out


def least_squares(a: np.ndarray, h: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 that makes ``a @ x`` nearest to ``h``: columns enter by their gradient, negative ones leave at the boundary."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ h
    done = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(most):
        free = np.where(inside, -np.inf, gradient)
        enter = int(free.argmax())
        if free[enter] <= done or inside.all():
            break
        inside[enter] = True
        while True:
            at = np.flatnonzero(inside)
            own = a[:, at]
            z = np.linalg.lstsq(own, h, rcond=None)[0] if len(at) > len(h) else np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(at)), own.T @ h)
            low = z <= 0
            if not low.any():
                x[:] = 0
                x[at] = z
                break
            step = (x[at[low]] / np.maximum(x[at[low]] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            x[gone] = 0
            inside[gone] = False
            if not len(gone):
                break
        gradient = a.T @ (h - a @ x)
    return x


def shallow(counts: np.ndarray, window: int = WINDOW, width: int = CLASS) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """([({length: times}, windows)], counts left): repeat counts by least squares over classes, rounded down.

    In a class the longest lengths go first: they leave least empty.
    """
    parts = window // width
    held = np.zeros(parts + 1)
    np.add.at(held, -(-np.arange(len(counts)) // width), counts)
    combos = [c for c in combinations(parts) if len(c) > 1 and all(held[list(c)] > 0)]
    left = counts.copy()
    if not combos:
        return [], left
    a = np.zeros((parts + 1, len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], list(c), 1)
    repeats = np.floor(least_squares(a, held) + 1e-6).astype(np.int64)
    queue = {b: [l for l in range(min(b * width, len(left) - 1), (b - 1) * width, -1) if left[l] > 0] for b in range(1, parts + 1)}
    out = []
    for j in np.flatnonzero(repeats).tolist():
        n = int(repeats[j])
        while n:
            used: dict[int, int] = {}
            for b in combos[j]:
                while queue[b] and left[queue[b][0]] <= 0:
                    queue[b].pop(0)
                own = next((l for l in queue[b] if left[l] > used.get(l, 0)), None)
                if own is None:
                    used = {}
                    break
                used[own] = used.get(own, 0) + 1
            if not used:
                break
            times = min(n, *(int(left[l]) // t for l, t in used.items()))
            for l, t in used.items():
                left[l] -= t * times
            out.append((used, times))
            n -= times
    return out, left


def greedy(counts: np.ndarray, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Largest first, each window filled by the largest that fit, as often as the counts allow: every step uses up a length."""
    left, out = counts.copy(), []
    while len(there := np.flatnonzero(left)):
        used, space = {int(there[-1]): 1}, window - int(there[-1])
        while space > 0:
            l = next((l for l in map(int, np.flatnonzero(left[: space + 1])[::-1]) if left[l] > used.get(l, 0)), None)
            if l is None:
                break
            t = min(space // l, int(left[l]) - used.get(l, 0))
            used[l] = used.get(l, 0) + t
            space -= t * l
        times = min(int(left[l]) // t for l, t in used.items())
        for l, t in used.items():
            left[l] -= t * times
        out.append((used, times))
    return out


@dataclass
class Plan:
    """Where the i-th piece of each length goes.

    ``whole`` has rows (length, first i, sequence, offset, pieces of it in a window) by length and i; ``laid`` rows (length, first i, place)
    give places in the stream that is cut at ``borders`` of ``starts``: the sequences from ``stream`` on. ``counts`` is the histogram.
    """

    counts: np.ndarray
    whole: np.ndarray
    laid: np.ndarray
    first_laid: np.ndarray
    stream: int
    total: int
    window: int

    def tail(self) -> np.ndarray:
        """Borders of the stream's sequences after its last whole window: powers of two, largest first."""
        rest, at, out = self.total % self.window, self.total - self.total % self.window, []
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                out.append(at)
                at += 1 << bit
        return np.array([*out, at], np.int64)

    def sequences(self) -> int:
        return self.stream + self.total // self.window + max(0, len(self.tail()) - 1)


def planned(counts: np.ndarray, window: int = WINDOW, waste: int = WASTE) -> Plan:
    """A plan for ``counts`` (by length 0 to ``window``) pieces; its size follows from the window, not from the counts."""
    counts = counts.astype(np.int64)
    rest = counts.copy()
    rest[window] = 0
    combos, left = shallow(rest, window)
    fills = lambda c: window - sum(l * t for l, t in c[0].items()) <= waste
    more = greedy(left, window)
    combos = ([({window: 1}, int(counts[window]))] if counts[window] else []) + combos + [c for c in more if fills(c)]
    done, whole, seq = np.zeros(window + 1, np.int64), [], 0
    for used, times in combos:
        offset = 0
        for l, t in sorted(used.items(), reverse=True):
            whole.append((l, done[l], seq, offset, t))
            done[l] += t * times
            offset += l * t
        seq += times
    first, laid, at = done.copy(), [], 0
    for l in range(window, 0, -1):
        if counts[l] > done[l]:
            laid.append((l, done[l], at))
            at += l * int(counts[l] - done[l])
    return Plan(counts, np.array(sorted(whole), np.int64).reshape(-1, 5), np.array(sorted(laid), np.int64).reshape(-1, 3), first, seq, at, window)


def located(plan: Plan, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, skip, length, sequence, offset) of the pieces that rows of a length and number become; ``skip`` ids precede a piece in its row."""
    row = np.arange(len(length))
    laid = nth >= plan.first_laid[length]
    own = row[~laid]
    key = lambda l, i: (l << 48) + i
    at = np.searchsorted(key(plan.whole[:, 0], plan.whole[:, 1]), key(length[own], nth[own]), side="right") - 1
    _, low, seq, offset, times = plan.whole[at].T if len(own) else np.zeros((5, 0), np.int64)
    k = nth[own] - low
    parts = [(own, np.zeros(len(own), np.int64), length[own], seq + k // np.maximum(times, 1), offset + k % np.maximum(times, 1) * length[own])]
    own = row[laid]
    if len(own):
        at = np.searchsorted(plan.laid[:, 0], length[own])
        begin = plan.laid[at, 2] + (nth[own] - plan.laid[at, 1]) * length[own]
        end, tail, windows = begin + length[own], plan.tail(), plan.total // plan.window
        number = lambda p: np.where(p < windows * plan.window, p // plan.window, windows + np.searchsorted(tail, p, side="right") - 1)
        start_of = lambda s: np.where(s < windows, s * plan.window, tail[np.clip(s - windows, 0, len(tail) - 1)])
        n = number(end - 1) - number(begin) + 1
        which = np.repeat(np.arange(len(own)), n)
        s = number(begin)[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.maximum(begin[which], start_of(s)), np.minimum(end[which], start_of(s + 1))
        parts.append((own[which], a - begin[which], b - a, plan.stream + s, a - start_of(s)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


# -- documents


def encoded(docs: DataFrame, path: str, end: int | None = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (part, row, doc_id, doc_tokens, full_nth, rest_nth, crcs, ids), a row per document.

    ``ids`` are little-endian 32-bit, ``crcs`` the CRC-32 of each window's and the rest's. ``full_nth`` and
    ``rest_nth`` number the document's first window and its rest among those of the same length in its
    part: they are final only as written, so everything after reads the table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen, row = wordids.encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), 0
        for batch in batches:
            texts, first = batch.column(1), 0
            if not len(texts):
                continue
            sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset)), dtype=np.int64)
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_BYTES, side="right")))
                ids, ends = enc.encode(texts.slice(first, last - first))
                if end is not None:
                    ids, ends = np.insert(ids, ends, np.int32(end)), ends + np.arange(1, len(ends) + 1)
                n = np.diff(ends, prepend=0)
                full, rest = n // window, n % window
                order = np.argsort(rest, kind="stable")
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - np.searchsorted(rest[order], rest[order])
                nth += seen[rest]
                full_nth = seen[window] + np.cumsum(full) - full
                seen[:window] += np.bincount(rest, minlength=window)[:window]
                seen[window] += full.sum()
                raw = memoryview(ids.astype("<i4").tobytes())
                crcs = [[zlib.crc32(raw[4 * a : 4 * min(a + window, e)]) for a in range(s, e, window)] for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                places = np.concatenate([[0], ends * 4]).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(raw)]).cast(pa.binary())
                numbers = [pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n)))]
                yield pa.RecordBatch.from_arrays([*numbers, batch.column(0).slice(first, last - first), pa.array(n), pa.array(full_nth), pa.array(nth), pa.array(crcs, pa.list_(pa.int64())), blob], ["part", "row", "doc_id", "doc_tokens", "full_nth", "rest_nth", "crcs", "ids"])
                row += len(n)
                first = last
        tidy()

    return written(rows.mapInArrow(run, f"part int, row long, doc_id {id_type}, doc_tokens long, full_nth long, rest_nth long, crcs array<long>, ids binary"), "encoded")


def _placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """``pieces`` (part, row, doc_id, start, length, crc, doc_tokens, nth) cut and placed: nth gives way to sequence_id, offset and cut."""
    id_type = dict(pieces.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in (3, 4, 7)]
            row, skip, length, seq, offset = located(plan, own[1], own[2])
            at = pa.array(row)
            keep = [batch.column(i).take(at) for i in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(own[0][row] + skip), pa.array(length), batch.column(5).take(at), batch.column(6).take(at), pa.array(seq), pa.array(offset), pa.array(length != own[1][row])], ["part", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"])

    return pieces.mapInArrow(run, f"part int, row long, doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean")


def packed(docs: DataFrame, path: str, end: int | None = END, window: int = WINDOW, waste: int = WASTE, **cols) -> tuple[DataFrame, DataFrame]:
    """(pieces, encoded): where each part of each document goes, and the table with the ids.

    ``pieces`` has part, row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. A null or empty text is its
    end token alone (without one: no piece); repeated rows are documents of their own, a null id stays null;
    an empty table gives no rows. Sequences are gapless from offset 0; those shorter than ``window``
    lack ``waste`` tokens at most, a few more in combinations of classes, or are powers of two.
    """
    rows = encoded(docs, path, end, window, **cols)
    own = rows.select("part", "row", "doc_id", "doc_tokens", "full_nth", "rest_nth", F.posexplode("crcs").alias("j", "crc"))
    length = F.least(F.lit(window), F.col("doc_tokens") - F.col("j") * window)
    own = own.select("part", "row", "doc_id", (F.col("j").cast("long") * window).alias("start"), length.alias("length"), "crc", "doc_tokens", F.when(length == window, F.col("full_nth") + F.col("j")).otherwise(F.col("rest_nth")).alias("nth"))
    parts = written(own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(window + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length: at most ``window``
        counts[r["length"]] = r["n"]
    plan = planned(counts, window, waste)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = own.join(bases, ["part", "length"]).select("part", "row", "doc_id", "start", "length", "crc", "doc_tokens", (F.col("nth") + F.col("base")).alias("nth"))
    placed = _placed(numbered, plan)
    if plan.total:
        placed = written(placed, "placed")
        cut = placed.filter("cut")
        texts = rows.filter((F.col("doc_tokens") % window).isin([int(l) for l in plan.laid[:, 0]])) if len(plan.laid) <= 200 else rows
        few = 2 * (plan.sequences() - plan.stream) <= FEW  # a border cuts one piece in two
        met = texts.select("part", "row", "ids").join(F.broadcast(cut) if few else cut, ["part", "row"])
        cut = met.withColumn("ids_crc32", F.crc32(F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))).select(placed.columns)
        placed = placed.filter("not cut").unionByName(cut)
    return placed.drop("cut"), rows


def sequences(docs: DataFrame, path: str, window: int = WINDOW, pad: int = 0, **kw) -> DataFrame:
    """(sequence_id, n_tokens, ids array<int>, doc_ids): the packed sequences themselves, padded to ``window`` unless a power of two.

    ``doc_ids`` lists the piece of which document stands where, in order, for masks between documents.
    """
    pieces, rows = packed(docs, path, window=window, **kw)
    met = pieces.join(rows.select("part", "row", "ids"), ["part", "row"]).withColumn("_b", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    met = met.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "_b"))).alias("own"), F.sum("length").alias("n_tokens"))

    id_type = dict(pieces.dtypes)["doc_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs_ = [], []
            for own, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                flat = np.frombuffer(b"".join(p["_b"] for p in own), "<i4").tolist()
                ids.append(flat if n & (n - 1) == 0 else flat + [pad] * (window - n))
                docs_.append([p["doc_id"] for p in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(docs_, pa.list_(batch.column(1).type.value_type.field("doc_id").type))], ["sequence_id", "n_tokens", "ids", "doc_ids"])

    return met.select("sequence_id", "own", "n_tokens").mapInArrow(joined, f"sequence_id long, n_tokens long, ids array<int>, doc_ids array<{id_type}>")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of ``documents``; cases as in ``packed``."""
    import public_tokenizers

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return settled(lambda: packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))[0].select(*names), "packed")
