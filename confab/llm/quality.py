"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over statistics of the whole text are taken apart into their paths; each path
is a conjunctive rule. A lasso logistic regression weighs rules and clipped statistics, most of them
to zero, and what is left is compiled into one Spark column expression.
Training uses a bounded sample of the labelled rows (``MAX_TRAIN``, by hash); scores cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confab.llm.common import table
from confab.llm.textkernel import flat, pieces, tidy, words

MAX_TRAIN = 20_000
STATS = ("log_chars", "word_chars", "upper", "symbols", "exclaims", "digits", "stops", "bars", "markup", "wide", "line_words", "new_lines", "new_words", "ended")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": b"#$%&*@^~=+_\\", "exclaims": b"!?", "digits": b"0123456789", "stops": b".,;:", "bars": b"|", "markup": b"<>{}[]", "lines": b"\n"}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; an empty text has zeros."""
    n = np.diff(offsets)
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    count = {}
    for name, chars in _CLASSES.items():
        flag = np.zeros(256, bool)
        flag[list(chars)] = True
        total = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
        count[name] = total[offsets[1:]] - total[offsets[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 0xC0, dtype=np.int64)])
    wide = wide[offsets[1:]] - wide[offsets[:-1]]
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = np.maximum(1, size[first[1:]] - size[first[:-1]])
    per_word, lines = np.maximum(1, n_words), count["lines"] + (n > 0)
    fresh = np.zeros((len(n), 3))
    raw = data.tobytes()
    for i in range(len(n)):
        text = raw[offsets[i] : offsets[i + 1]]
        own = [x for x in text.split(b"\n") if x]
        if own:
            fresh[i] = len(set(own)) / len(own), len(set(text.split())) / per_word[i], sum(x[-1] in b".!?:;" for x in own) / len(own)
    out = np.column_stack([
        np.log1p(n), solid / per_word, count["upper"] / solid, count["symbols"] / solid, count["exclaims"] / per_word, count["digits"] / solid, count["stops"] / per_word,
        count["bars"] / per_word, count["markup"] / solid, wide / solid, n_words / np.maximum(1, lines), fresh[:, 0], fresh[:, 1], fresh[:, 2],
    ])
    out[n_words == 0] = 0.0
    return np.round(out, 9)


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with a column _stats: struct of STATS."""
    keep = docs.columns if keep is None else keep
    at = docs.columns.index(text_col)
    order = [docs.columns.index(c) for c in keep]
    schema = docs.select(*keep).schema.add("_stats", T.StructType([T.StructField(c, T.DoubleType()) for c in STATS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            for a, b in pieces(offsets, 1 << 20):
                got = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                stats = pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(STATS))], names=list(STATS))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in order), stats], names=schema.names)
        tidy()

    return docs.mapInArrow(run, schema)


@dataclass
class RuleModel:
    """intercept + weighted rules (conjunctions of (stat, above, bound)) + weighted clipped statistics."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]] = field(default_factory=list)
    linear: list[tuple[float, int, float, float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            hold = None
            for i, above, bound in rule:
                one = stats[STATS[i]] > bound if above else stats[STATS[i]] <= bound
                hold = one if hold is None else hold & one
            total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, i, low, high in self.linear:
            total = total + F.lit(weight) * F.least(F.greatest(stats[STATS[i]], F.lit(low)), F.lit(high))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, depth: int, least: int):
    """Rules (paths, inner ones too) of a tree grown on the gradient, and its prediction for each row."""
    rules, out = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows], hess[rows]
        value = g.sum() / (h.sum() + 1.0)
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for j, edges in enumerate(bins):
                if not len(edges):
                    continue
                c = codes[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, len(edges) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if path:
            rules.append(path)
        if best[1] is None:
            out[rows] = value
            return
        j, k = best[1]
        low = codes[rows, j] <= k
        grow(rows[low], (*path, (j, False, float(bins[j][k]))), left - 1)
        grow(rows[~low], (*path, (j, True, float(bins[j][k]))), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, steps: int = 600) -> RuleModel:
    """Fits on rows of statistics ``x`` and labels ``y`` (0 or 1). Without both labels the score is constant."""
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return RuleModel(start)
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bins)])
    least, rules, f = max(5, len(y) // 500), {}, np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, step = _tree(x, y - p, p * (1 - p), bins, codes, depth, least)
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in paths))
        f += 0.3 * step
    rules = list(rules)
    holds = lambda r: np.all([x[:, i] > b if above else x[:, i] <= b for i, above, b in r], axis=0)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    used = [j for j in range(x.shape[1]) if high[j] > low[j]]
    clipped = np.clip(x, low, high)
    spread = np.array([clipped[:, j].std() or 1.0 for j in used])
    a = np.column_stack([*(holds(r).astype(float) for r in rules), *(0.4 * clipped[:, j] / s for j, s in zip(used, spread, strict=True))])
    mean = a.mean(axis=0)
    a = a - mean
    size = 4.0 / max(1e-9, np.linalg.norm(a, 2) ** 2 / len(y))
    w, v, b, bv, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), start, start, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(a @ v + bv))) - y
        z = v - size * (a.T @ r) / len(y)
        new, nb, nt = np.sign(z) * np.maximum(0, np.abs(z) - size * penalty), bv - 4.0 * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    model = RuleModel(float(b - w @ mean))
    model.rules = [(float(c), r) for c, r in zip(w, rules, strict=False) if c]
    model.linear = [(float(0.4 * c / s), j, float(low[j]), float(high[j])) for c, s, j in zip(w[len(rules) :], spread, used, strict=True) if c]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, **kw) -> RuleModel:
    """Learns ``label_col`` from at most ``max_train`` labelled rows that aren't held out, taken by hash of doc_id.

    Rows whose label is not 0 or 1 or whose id is null are left out. Where ids repeat in ``docs``, at most
    four rows for each label are taken, by hash too, so that reruns agree. Without rows the score is 0.5.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").filter(~held_out(F.col("_id")))
    own = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text"), keep=["doc_id", "_y"])
    got = rows.select("_y", "_stats.*", "doc_id").orderBy(F.xxhash64("doc_id", *STATS), "doc_id", "_y").limit(4 * max_train).toPandas().sort_values(["doc_id", *STATS])
    if not len(got):
        return RuleModel(0.0)
    return fit(got[list(STATS)].to_numpy(float), got["_y"].to_numpy(float), **kw)


def scored(docs: DataFrame, model: RuleModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with score and predicted; such columns of its own are replaced.

    A row per input row. A null or empty text has zero statistics and the score of those; repeated rows get
    equal scores; a score of just 0.5 predicts 1; an empty table gives no rows.
    """
    own = docs.select(*[c for c in docs.columns if c not in ("score", "predicted", "_stats")])
    rows = with_statistics(own, keep=None if keep is None else keep)
    return rows.withColumn("score", model.score(F.col("_stats"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_stats")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``, learnt from the labels that aren't held out; cases as in ``scored``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
