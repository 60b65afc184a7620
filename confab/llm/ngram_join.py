"""N-gram Jaccard join over a prefix tree of globally ordered shingle sets.

Order: document frequency, counted over all distinct sets, then hash: rare shingles first. Shingles
travel as packed hashes to the reducer of their range, which returns only shared ones; shingles of
one set alone can't overlap with anything. A set whose shared shingles can't reach the threshold is
done. What is left is filed under the shared shingles of its prefix (the fewest that any partner must
meet), in cells around a leader. A cell stores its sets in a trie; a probe walks it with the overlap
that a path has so far, and prunes subtrees by what path and probe have left. Linked sets become one
component at once, and subtrees of the probe's own component are skipped, so a large group of near
copies costs about its size. Then every prefix shingle under which two components still meet gets an
exact cell (large ones in blocks, by number or by shingles, against blocks of a size that can link), in which parities of the sets'
hashes rule out, exactly, those that can't link before their tries are built. Equal sets are one node from the
start, named by a digest; where two sets have one digest, a second one tells them apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import settling, table, written
from confab.llm.graphs import components
from confab.llm.textkernel import flat, mix, pieces, run_hashes, tidy, word_hashes, words

WORDS = 5
PERCENT = 80
CELL = 512
#: Shingles of a cell's sets, on average: cells of long sets hold fewer of them.
WEIGHT = 1 << 23
#: Blocks of a shingle up to which all meet all; beyond, sizes tell which can link.
FEW = 3
#: Shingles in a range of hashes, on average: what a reducer holds at once.
RANGE = 1_000_000
#: Digests of several sets beyond which something else than chance is at work.
MOST_TWICE = 100_000
#: Sets of one batch under one shingle beyond which it counts as very common and isn't sent to one reducer.
COMMON = 32
#: Bytes of texts worked on at once; tables of powers are as long, so just below a power of two.
_PIECE = (1 << 21) - 1
_MOST = 1023


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, their offsets, two digests of each row's set as columns)."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    grams = run_hashes(hashes, k)
    sets, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= k:
            own = np.unique(grams[a : b - k + 1])
        elif b > a:
            own = run_hashes(hashes[a:b], b - a)
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    digest = np.zeros((len(sizes), 2), np.uint64)
    with np.errstate(over="ignore"):
        for x, seed in enumerate((77, 0x5851F42D4C957F2D)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(all_ + np.uint64(seed)), dtype=np.uint64)])
            digest[:, x] = mix(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64))
    return all_, at, digest


def _infos(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, other): size and two digests of each document's set; both null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in pieces(offsets, _PIECE):
                _, at, digest = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                names = [pa.array(digest[:, x].view(np.int64), mask=n == 0) for x in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *names], ["doc_id", "n", "node", "other"])
        tidy()

    return docs.mapInArrow(run, "doc_id long, n long, node long, other long")


def named_sets(infos: DataFrame) -> tuple[DataFrame, list[int]]:
    """(``infos`` (doc_id, n, node) in which different sets have different nodes, the digests that several sets had).

    A set whose first digest is also another's is named by its second one. Of N sets some N * N / 2 ** 65
    pairs are to be expected: a few among ten billion sets, so the list is short at any size.
    """
    seen = infos.filter("node is not null").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).filter("low <> high")
    twice = sorted(r["node"] for r in seen.select("node").limit(MOST_TWICE + 1).collect())
    if len(twice) > MOST_TWICE:
        raise ValueError("far more equal digests than chance gives")
    name = F.when(F.col("node").isin(twice), F.col("other")).otherwise(F.col("node")) if twice else F.col("node")
    return infos.select("doc_id", "n", name.alias("node")), twice


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the range that a 53-bit hash is in; rises with the hash."""
    return (((h >> np.uint64(21)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _low(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Smallest hash of a bucket's range."""
    return ((bucket.astype(np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(21)


def _by_range(docs: DataFrame, buckets: int, twice: list[int]) -> DataFrame:
    """(bucket, nodes, counts, hashes, marks, passed_nodes, passed): shingle hashes of each batch's distinct sets, by range.

    ``marks`` are very common shingles; their (node, hash) pairs are ``passed`` on under the bucket of the node.
    Only ranges that a batch has something for get a row. Sets are named as ``named_sets`` names them.
    """
    again = np.array(twice, np.int64).view(np.uint64)
    names = ["bucket", "nodes", "counts", "hashes", "marks", "passed_nodes", "passed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in pieces(offsets, _PIECE):
                grams, at, digest = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                names_ = np.where(np.isin(digest[:, 0], again), digest[:, 1], digest[:, 0]) if len(again) else digest[:, 0]
                rows = np.sort(np.flatnonzero(n > 0)[np.unique(names_[n > 0], return_index=True)[1]])
                nodes, slot_of = names_[rows], np.full(len(n), -1, np.int64)
                slot_of[rows] = np.arange(len(rows))
                slot = np.repeat(slot_of, n)
                h, slot = grams[slot >= 0] >> np.uint64(11), slot[slot >= 0]
                order = np.argsort(h, kind="stable")  # slots stay in order
                h, slot = h[order], slot[order]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                run_ = np.diff(np.append(edge, len(h)))
                marks = h[edge[run_ > COMMON]]
                common = np.repeat(run_ > COMMON, run_)
                to = (nodes[slot[common]] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, passed, passed_slot = to[order], h[common][order], slot[common][order]
                h, slot = h[~common], slot[~common]
                bucket, marks_at = _bucket(h, buckets), _bucket(marks, buckets)
                order = np.lexsort((h, slot, bucket))
                h, slot, bucket = (h - _low(bucket, buckets))[order], slot[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (slot[1:] != slot[:-1])])) if len(h) else np.zeros(0, np.int64)
                counts = np.diff(np.append(edge, len(h))).astype(np.uint32)
                packed = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]
                used = np.unique(np.concatenate([bucket, marks_at, to]))
                span = lambda column: zip(*(np.searchsorted(column, used, side=x).tolist() for x in ("left", "right")), strict=True)
                cut = zip(span(bucket[edge]), span(bucket), span(marks_at), span(to), strict=True)
                out = [[nodes[slot[edge[e0:e1]]].tobytes(), counts[e0:e1].tobytes(), packed[h0:h1].tobytes(), marks[m0:m1].tobytes(), nodes[passed_slot[p0:p1]].tobytes(), passed[p0:p1].tobytes()] for (e0, e1), (h0, h1), (m0, m1), (p0, p1) in cut]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], names)
        tidy()

    return docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))


def _wide(table_: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table_.column(name).to_pylist()), kind)


def _shared(parts: DataFrame, buckets: int) -> DataFrame:
    """(node, tokens): the shingles that at least one other set has too, in global order."""

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        low = _low(np.array([bucket]), buckets)[0]
        node = np.repeat(_wide(group, "nodes", np.uint64), _wide(group, "counts", np.uint32))
        six = _wide(group, "hashes", np.uint8).reshape(-1, 6)
        h = np.zeros((len(six), 8), np.uint8)
        h[:, :6] = six
        h = h.view(np.uint64).ravel()
        del six
        order = np.argsort(h)
        h, node = h[order], node[order]
        marks = np.unique(_wide(group, "marks", np.uint64)) - low
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        run = np.diff(np.append(edge, len(h)))
        some = np.repeat((run > 1) | np.isin(h[edge], marks), run)
        h, node = h[some], node[some]
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        if len(h):  # equal sets of several batches count once
            one = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node = h[one], node[one]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        run = np.diff(np.append(edge, len(h)))
        frequency = np.where(np.isin(h[edge], marks), _MOST, np.minimum(run, _MOST - 1)).astype(np.uint64)
        keep = np.repeat(frequency > 1, run)
        token = ((np.repeat(frequency, run) << np.uint64(54)) | (h + low))[keep]
        node = np.concatenate([node[keep], _wide(group, "passed_nodes", np.uint64)])
        token = np.concatenate([token, (np.uint64(_MOST) << np.uint64(54)) | _wide(group, "passed", np.uint64)])
        to = (node % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, to))
        node, token, to = node[order], token[order], to[order]
        del h, order, edge, run
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edge, len(node))).astype(np.uint32)
        own, first = np.unique(to[edge], return_index=True)
        ends = np.append(first, len(edge))[1:]
        starts, stops = np.append(edge, len(node))[first], np.append(edge, len(node))[ends]
        blobs = [(node[edge[a:b]].tobytes(), counts[a:b].tobytes(), token[s:e].tobytes()) for a, b, s, e in zip(first.tolist(), ends.tolist(), starts.tolist(), stops.tolist(), strict=True)]
        tidy()
        return pa.table({"bucket": pa.array(own.astype(np.int32)), **{c: pa.array([x[i] for x in blobs], pa.binary()) for i, c in enumerate(("nodes", "counts", "tokens"))}})

    def collect(group: pa.Table) -> pa.Table:
        node = np.repeat(_wide(group, "nodes", np.uint64), _wide(group, "counts", np.uint32))
        token = _wide(group, "tokens", np.uint64)
        order = np.lexsort((token, node))
        node, token = node[order], token[order]
        one = np.concatenate([[True], (node[1:] != node[:-1]) | (token[1:] != token[:-1])]) if len(node) else np.zeros(0, bool)
        node, token = node[one], token[one]
        nodes, counts = np.unique(node, return_counts=True)
        del order, one, node
        tidy()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(token.view(np.int64)))
        return pa.table({"node": pa.array(nodes.view(np.int64)), "tokens": lists})

    returned = parts.groupBy("bucket").applyInArrow(count, "bucket int, nodes binary, counts binary, tokens binary")
    return returned.groupBy("bucket").applyInArrow(collect, "node long, tokens array<long>")


class Trie:
    """Sets as paths of ordered tokens; sets with a common beginning share its nodes."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(tokens)), key=lambda i: tokens[i].astype(">u8").tobytes())
        self.tokens, self.sizes = [tokens[i] for i in self.order], sizes[self.order]
        self.lengths = np.array([len(t) for t in self.tokens])
        lcp = []
        for a, b in zip(self.tokens, self.tokens[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            lcp.append(int(differ[0]) if len(differ) else n)
        self.lcp = np.array(lcp, np.int64)
        self.nodes: list[tuple] = []  # low, high, label, depth at its end, smallest set, longest path, children
        self.root = self._build(0, len(tokens))

    def _build(self, low: int, high: int) -> int:
        todo, made = [(low, high, 0, -1)], []
        while todo:
            low, high, depth, parent = todo.pop()
            end = int(self.lengths[low]) if high - low == 1 else int(self.lcp[low : high - 1].min())
            at = len(made)
            made.append((low, high, self.tokens[low][depth:end], end, int(self.sizes[low:high].min()), int(self.lengths[low:high].max()), []))
            if parent >= 0:
                made[parent][6].append(at)
            if high - low > 1:
                cuts = [low, *(np.flatnonzero(self.lcp[low : high - 1] == end) + low + 1).tolist(), high]
                todo += [(a, b, end, at) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.nodes = made
        return 0

    def links(self, labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
        """Pairs (positions in the input) that join components; ``labels`` are those known before."""
        label, out = labels[self.order].copy(), []
        for i, (x, n) in enumerate(zip(self.tokens, self.sizes.tolist(), strict=True)):
            todo = [(self.root, 0)]
            while todo:
                at, overlap = todo.pop()
                low, high, edge, depth, smallest, longest, children = self.nodes[at]
                low = max(low, i + 1)
                if low >= high or (label[low:high] == label[i]).all():
                    continue
                left = len(x)
                if len(edge):
                    place = np.searchsorted(x, edge)
                    overlap += int((x[np.minimum(place, len(x) - 1)] == edge).sum())
                    left = len(x) - int(np.searchsorted(x, edge[-1], side="right"))
                elif depth:
                    left = len(x) - int(np.searchsorted(x, self.tokens[low][depth - 1], side="right"))
                size = max(smallest, -(-percent * n // 100))
                if (100 + percent) * (overlap + min(longest - depth, left)) < percent * (n + size):
                    continue
                if children:
                    todo += [(c, overlap) for c in reversed(children)]
                    continue
                j, m = low, int(self.sizes[low])
                if 100 * overlap >= percent * (n + m - overlap) and label[j] != label[i]:
                    out.append((self.order[i], self.order[j]))
                    label[label == label[j]] = label[i]
        return out


def _cells(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of each cell of ``rows`` (cell, node, n, label, tokens)."""

    def solve(cell: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        held = {x[0]: x for x in cell}
        if len(held) < 2:
            return []
        node, n, label, tokens = zip(*held.values(), strict=True)
        return [(node[i], node[j]) for i, j in Trie(list(tokens), np.array(n)).links(np.array(label))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, edges = None, [], []
        for batch in batches:
            cells, nodes, sizes, labels = (batch.column(i).to_pylist() for i in range(4))
            for i, c in enumerate(cells):
                if c != now:
                    edges += solve(cell)
                    now, cell = c, []
                cell.append((nodes[i], sizes[i], labels[i], batch.column(4)[i].values.to_numpy().view(np.uint64)))
        edges += solve(cell)
        cell = []
        tidy()
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = rows.select("cell", "node", "n", "label", "tokens").repartition("cell").sortWithinPartitions("cell", "node")
    return ordered.mapInArrow(run, "a long, b long")


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each token hash modulo a power of two, at least four times their number: set where an odd number falls."""
    width = 1 << max(6, int(4 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _with_parity(sets: DataFrame) -> DataFrame:
    """(node, n, s, bits) of ``sets`` (node, n, tokens): the number of tokens and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [x.values.to_numpy().view(np.uint64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in tokens], pa.int64()), pa.array([parity(x) for x in tokens], pa.binary())], ["node", "n", "s", "bits"])

    return sets.select("node", "n", "tokens").mapInArrow(run, "node long, n long, s long, bits binary")


def feasible(n: np.ndarray, s: np.ndarray, label: np.ndarray, bits: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which sets of a cell may link with one of another component.

    Two sets differ in at least as many tokens as their parities do, folded to the shorter length: that
    bounds their overlap from above, and no pair that links is missed.
    """
    may = np.zeros(len(n), bool)
    words_ = [np.frombuffer(b, np.uint64) for b in bits]
    width = np.array([len(w) for w in words_])
    folded = {}
    for i in range(len(n)):
        other = np.flatnonzero((label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (np.arange(len(n)) > i))
        for size in np.unique(np.minimum(width[other], width[i])).tolist():
            own = other[np.minimum(width[other], width[i]) == size]
            for j in (i, *own.tolist()):
                if (j, size) not in folded:
                    folded[j, size] = np.bitwise_xor.reduce(words_[j].reshape(-1, size), axis=0)
            apart = np.bitwise_count(np.stack([folded[j, size] for j in own.tolist()]) ^ folded[i, size]).sum(axis=1, dtype=np.int64)
            own = own[(100 + percent) * (s[own] + s[i] - apart) >= 2 * percent * (n[own] + n[i])]
            may[own] = True
            may[i] |= len(own) > 0
    return may


def _feasible(rows: DataFrame) -> DataFrame:
    """(cell, node, label) of the ``rows`` (cell, node, label, n, s, bits) that may link in their cell."""

    def solve(cell: list[tuple]) -> list[tuple]:
        held = list({x[1]: x for x in cell}.values())
        if len(held) < 2:
            return []
        n, s, label = (np.array([x[k] for x in held]) for k in (3, 4, 2))
        return [held[i][:3] for i in np.flatnonzero(feasible(n, s, label, [x[5] for x in held])).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != now:
                    out += solve(cell)
                    now, cell = row[0], []
                cell.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["cell", "node", "label"])
        out = solve(cell)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["cell", "node", "label"])

    ordered = rows.select("cell", "node", "label", "n", "s", "bits").repartition("cell").sortWithinPartitions("cell", "node")
    return ordered.mapInArrow(run, "cell long, node long, label long")


def _blocked(own: DataFrame, percent: int, parts: Callable) -> DataFrame:
    """(cell, node, label) of the members ``own`` (token, node, label, size, n) of very common shingles.

    ``parts`` gives the number of blocks for a number of sets and their shingles. Sets that link differ in
    size by less than two classes of a geometric scale: blocks of a class meet those of their own and of the
    next class, no others.
    """
    scale = math.log(100 / percent) * (1 + 1e-9)
    own = own.withColumn("class", F.floor(F.log("n") / scale))
    per = written(own.groupBy("token", "class").agg(parts(F.count(F.lit(1)), F.sum("size")).alias("blocks")), "classes")
    at = lambda by, name: per.select("token", (F.col("class") + by).alias("class"), F.col("blocks").alias(name))
    rows = own.join(per, ["token", "class"]).join(at(1, "below"), ["token", "class"], "left").join(at(-1, "above"), ["token", "class"], "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    numbers = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    named = lambda kind, low, a, b: F.xxhash64("token", F.lit(kind), low, a, b)
    cells = F.concat(
        F.transform(numbers(F.col("blocks")), lambda o: named(0, F.col("class"), F.least(block, o), F.greatest(block, o))),
        F.transform(numbers(F.col("above")), lambda o: named(1, F.col("class"), block, o)),
        F.transform(numbers(F.col("below")), lambda o: named(1, F.col("class") - 1, o, block)),
    )
    return rows.select(F.explode(cells).alias("cell"), "node", "label")


def near_links(infos: DataFrame, docs: DataFrame, buckets: int, twice: list[int], percent: int = PERCENT, cell: int = CELL, weight: int = WEIGHT) -> DataFrame | None:
    """(node, label) of the sets with links to other sets; None without any."""
    shared = _shared(_by_range(docs, buckets, twice), buckets)
    sizes = infos.filter("node is not null").groupBy("node").agg(F.max("n").alias("n"))
    sets = shared.join(sizes, "node").filter(F.size("tokens") * 100 >= F.col("n") * percent)
    sets = written(sets, "candidates")
    alone = F.col("n") - F.size("tokens")
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    posted = written(sets.select("node", F.size("tokens").alias("size"), F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token")), "postings")
    parts = lambda many, size: F.ceil(F.greatest(many / cell, size / weight)).cast("int")
    mark = F.xxhash64("node")
    groups = posted.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("leader"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 34)).alias("s"), F.sum("size").alias("size")).filter("many > 1")
    groups = written(groups, "groups")
    once = groups.groupBy("many", "leader", "x", "s").agg(F.min("token").alias("token"))  # a group of the same members once
    pairs = posted.join(written(once.select("token", "leader"), "stars"), "token").select("leader", "node", "size").filter("leader <> node").distinct()
    pairs = written(pairs, "pairs")
    chunks = pairs.groupBy("leader").agg(parts(F.count(F.lit(1)), F.sum("size")).alias("chunks"))
    members = pairs.join(written(chunks, "chunks"), "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node")
    leaders = chunks.select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("node"))
    stars = members.unionByName(leaders).select(F.xxhash64("leader", "chunk").alias("cell"), "node")
    edges = written(_cells(stars.join(sets, "node").withColumn("label", F.col("node"))), "links")
    labels = components(edges) if not edges.isEmpty() else None
    known = posted.withColumn("label", F.col("node"))
    if labels is not None:
        known = posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = written(known, "known")
    mixed = known.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("token")
    rest = groups.join(mixed, "token", "left_semi").groupBy("many", "x", "s", "size").agg(F.min("token").alias("token"))
    rest = written(rest.select("token", parts(F.col("many"), F.col("size")).alias("blocks")), "rest")
    if not rest.isEmpty():
        few = known.join(rest.filter(F.col("blocks") <= FEW), "token")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        few = few.select("token", "node", "label", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        few = few.select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node", "label")
        often = known.join(rest.filter(F.col("blocks") > FEW).select("token"), "token").join(sets.select("node", "n"), "node")
        met = few.unionByName(_blocked(often, percent, parts)).join(_with_parity(sets), "node")
        met = written(_feasible(met), "feasible")  # short rows: full sets go only where a link is possible
        more = written(_cells(met.join(sets, "node")), "links")
        if not more.isEmpty():
            labels = components(edges.unionByName(more))
    return labels


@settling("near-groups")
def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, cell: int = CELL, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per input row.

    Words are split at white space, A-Z lower-cased; a set holds distinct shingles of ``WORDS`` words,
    or the whole sequence where it is shorter. Two documents link when their Jaccard similarity is
    ``PERCENT`` or more; component_id is the smallest id reachable. A null or empty text links with
    nothing and is its own component; rows without id never name a component unless all of its rows lack one.
    Repeated rows are one set; other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    infos, twice = named_sets(written(_infos(own), "sets"))
    buckets = buckets or max(32, -(-(infos.agg(F.sum("n")).first()[0] or 0) // RANGE))
    labels = near_links(infos, own, buckets, twice, cell=cell, weight=weight)
    named = infos.withColumn("label", F.col("node"))
    if labels is not None:
        named = written(infos.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = written(named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_groups`` of all of ``documents``."""
    return near_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE split_ AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM split_ WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN edges ON edges.a = reach.r
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id FROM split_ d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""
