"""Substring dedup on a compacted De Bruijn graph of words.

Nodes are short word k-mers; the edges between them are the windows of ``SPAN`` words. Each window is
filed under its minimiser k-mer (the anchor), a function of its words alone, and neighbouring windows
with one anchor are one path. A Spark aggregation over the anchors keeps the repeated ones and tells
whether all paths through an anchor read alike, and go on alike. Paths that don't branch are compacted:
a join of each with the one that follows it everywhere, and that nothing else precedes, makes them one
longer path, so a repeated passage is a row per document and not per word. Only at branching anchors are
paths taken apart into windows. Joins of these units give each one's first place in the corpus
(document, word). Later places are joined along the text into long spans with source coordinates, and a
span counts if its text, read again at both places, has one digest.

Hashes have 64 bits for the anchor and 64 more for what is compared under it. Texts move zstd-packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import settling, table, written
from confab.llm.textkernel import flat, mix, pieces, run_hashes, word_hashes, words

SPAN = 20
ANCHOR = 8
#: Bytes of texts worked on at once; tables of powers are as long, so just below a power of two.
_PIECE = (1 << 20) - 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` neighbours."""
    at, val, have = np.arange(len(values), dtype=np.int64), values, 1
    while have < width:
        step = min(have, width - have)
        left = val[:-step] <= val[step:]
        at, val = np.where(left, at[:-step], at[step:]), np.where(left, val[:-step], val[step:])
        have += step
    return at


class Paths:
    """Paths of a piece of texts: doc, first and last window (as words of the piece), anchor, content, and the next one's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int = SPAN, k: int = ANCHOR):
        self.span = span
        starts, ends, self.first = words(data, offsets)
        n = len(starts)
        self.doc = self.begin = self.end = np.zeros(0, np.int64)
        self.anchor = self.content = self.next = np.zeros(0, np.uint64)
        if n < span:
            return
        hashes = word_hashes(data, starts, ends)
        grams = run_hashes(hashes, k)
        at = sliding_argmin(grams, span - k + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        whole = doc[: n - span + 1] == doc[span - 1 :]
        fresh = np.ones(n - span + 1, bool)
        fresh[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
        begin = np.flatnonzero(fresh & whole)
        last = np.flatnonzero(whole & np.append(fresh[1:] | ~whole[1:], True))
        self.doc, self.begin, self.end, self.anchor = doc[begin], begin, last, grams[at[begin]]
        self.windows = run_hashes(hashes, span, seed=1)
        with np.errstate(over="ignore"):  # first and last window and the length fix the content
            self.content = mix(self.windows[begin] * np.uint64(3) + mix(self.windows[last] + (last - begin).astype(np.uint64)))
        follows = np.append(self.doc[1:] == self.doc[:-1], False) if len(begin) else np.zeros(0, bool)
        self.next = np.where(follows, np.append(self.content[1:], np.uint64(0)), np.uint64(0)) if len(begin) else self.content


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """no_id, did, th and text: a document is a row, equal ids and texts count as one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.xxhash64("text")).alias("did"), F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("th"), "text")


def _packed(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, no_id boolean, did long, th int, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = flat(batch.column(4))
            for a, b in pieces(offsets, 8 << 20):
                raw = data[offsets[a] : offsets[b]].tobytes()
                own = pa.array([z.compress(raw[offsets[i] - offsets[a] : offsets[i + 1] - offsets[a]]) for i in range(a, b)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), own], ["doc_id", "no_id", "did", "th", "packed"])

    return docs.mapInArrow(run, schema)


def _unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a packed column."""
    z, first, parts, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i in range(len(column)):
        parts.append(z.decompress(column[i].as_py()) if column[i].is_valid else b"")
        size += len(parts[-1])
        if size >= _PIECE or i + 1 == len(column):
            yield first, i + 1, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            first, parts, size = i + 1, [], 0


def _anchors(keyed: DataFrame, content: bool) -> DataFrame:
    """(anchor, content, next) or (anchor, did) of every path."""
    names = ["anchor", "content", "next"] if content else ["anchor", "did"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            dids = np.asarray(batch.column(0))
            for a, b in pieces(offsets, _PIECE):
                p = Paths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rest = [p.content, p.next] if content else [dids[a:b][p.doc]]
                yield pa.RecordBatch.from_arrays([_ints(x) for x in (p.anchor, *rest)], names)

    return keyed.select("did", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated_anchors(keyed: DataFrame) -> DataFrame:
    """(anchor, kind): 0 branches, 1 reads alike everywhere, 2 also goes on alike, into a path that only it precedes."""
    sides = [f(c).alias(f"{n}_{c}") for c in ("content", "next") for n, f in (("low", F.min), ("high", F.max))]
    found = _anchors(keyed, True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *sides).filter("n > 1")
    found = written(found.select("anchor", "n", (F.col("low_content") == F.col("high_content")).alias("alike"), F.col("low_content").alias("content"), F.when(F.col("low_next") == F.col("high_next"), F.col("low_next")).alias("next")), "paths")
    alike = found.filter("alike")
    # as often as its only successor: each of the successor's occurrences then has it before
    ahead = alike.groupBy(F.col("content").alias("next")).agg(F.max("n").alias("_n"), F.count(F.lit(1)).alias("_one")).filter("_one = 1")
    solid = alike.join(ahead, "next").filter(F.col("n") == F.col("_n")).select("anchor", F.lit(True).alias("_solid"))
    kind = F.when(~F.col("alike"), 0).when(F.col("_solid"), 2).otherwise(1)
    return found.join(solid, "anchor", "left").select("anchor", kind.alias("kind"))


def _units(rows: DataFrame) -> DataFrame:
    """(anchor, part, no_id, did, th, start, end) of the compacted paths and the windows at repeated anchors."""
    names = ["anchor", "part", "no_id", "did", "th", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no_id, did, th = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            lists = [batch.column(i) for i in (4, 5, 6)]
            for a, b, data, offsets in _unpacked(batch.column(3)):
                p = Paths(data, offsets)
                forks, straight, solid = (np.isin(p.anchor, np.unique(x.slice(a, b - a).flatten().to_numpy().view(np.uint64))) for x in lists)
                joined = np.zeros(len(p.doc), bool)
                joined[1:] = solid[:-1] & (straight | solid)[1:] & (p.doc[1:] == p.doc[:-1])
                one = np.flatnonzero((straight | solid) & ~joined)
                last = np.append(np.flatnonzero(~joined)[1:], len(joined)) - 1 if len(joined) else np.zeros(0, np.int64)
                last = last[np.searchsorted(np.flatnonzero(~joined), one)]
                many = np.flatnonzero(forks)
                sizes = p.end[many] - p.begin[many] + 1
                many = np.repeat(many, sizes)
                at = p.begin[many] + np.arange(len(many)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                path = np.concatenate([one, many])
                begin = np.concatenate([p.begin[one], at])
                end = np.concatenate([p.end[last], at]) + p.span
                part = np.concatenate([np.zeros(len(one), np.uint64), p.windows[at] if len(at) else np.zeros(0, np.uint64)])
                doc = p.doc[path]
                base = p.first[doc]
                yield pa.RecordBatch.from_arrays([_ints(p.anchor[path]), _ints(part), pa.array(no_id[a:b][doc]), pa.array(did[a:b][doc]), pa.array(th[a:b][doc]), pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names)

    return rows.select("no_id", "did", "th", "packed", "forks", "straight", "solid").mapInArrow(run, "anchor long, part long, no_id boolean, did long, th int, start int, end int")


_PLACE = "no_id boolean, did long, th int, start int, end int, s_no boolean, s_did long, s_th int, s_start int"


def _long_spans(later: DataFrame) -> DataFrame:
    """Places of ``_PLACE``: later units of a document that go on from one another at both places, as one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            own, rows = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            if not len(own):
                continue
            start, end, s_no, s_did, s_th, s_start = (x.to_numpy(zero_copy_only=False) for x in own.flatten())
            order = np.lexsort((start, s_start - start, s_th, s_did, s_no, rows))
            start, end, s_no, s_did, s_th, s_start, rows = (x[order] for x in (start, end, s_no, s_did, s_th, s_start, rows))
            key = [rows, s_no, s_did, s_th, s_start - start]
            group = np.cumsum(np.concatenate([[False], np.any([x[1:] != x[:-1] for x in key], axis=0)])).astype(np.int64)
            reach = np.maximum.accumulate(end.astype(np.int64) + (group << 32))
            new = np.concatenate([[True], start[1:] + (group[1:] << 32) > reach[:-1]])
            at = np.flatnonzero(new)
            stop = (np.append(reach[at[1:] - 1], reach[-1]) - (group[at] << 32)).astype(np.int32)
            took = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(took) for i in range(3)), pa.array(start[at]), pa.array(stop), pa.array(s_no[at]), pa.array(s_did[at]), pa.array(s_th[at]), pa.array(s_start[at])], [c.split()[0] for c in _PLACE.split(", ")])

    spans = F.collect_list(F.struct("start", "end", *[F.col(f"earliest.{a}").alias(b) for a, b in (("no_id", "s_no"), ("did", "s_did"), ("th", "s_th"), ("start", "s_start"))]))
    return later.groupBy("no_id", "did", "th").agg(spans.alias("spans")).mapInArrow(run, _PLACE)


def _digests(rows: DataFrame) -> DataFrame:
    """(span, digest) of the words that ``rows`` (packed, asked: spans, starts, ends) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            spans, start, end = batch.column(1).flatten().flatten()
            start, end, out, at = start.to_pylist(), end.to_pylist(), [], 0
            for packed, n in zip(batch.column(0), np.diff(batch.column(1).offsets.to_numpy()).tolist(), strict=True):
                own = z.decompress(packed.as_py()).split()
                out += [blake2b(b" ".join(own[a:b]), digest_size=16).digest() for a, b in zip(start[at : at + n], end[at : at + n], strict=True)]
                at += n
            yield pa.RecordBatch.from_arrays([spans, pa.array(out, pa.binary())], ["span", "digest"])

    return rows.select("packed", "asked").mapInArrow(run, "span long, digest binary")


def verified(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (``_PLACE``, span) whose texts at both places, read again, have one digest."""
    own = spans.select("no_id", "did", "th", F.struct("span", "start", "end").alias("x"))
    source = spans.select(F.col("s_no").alias("no_id"), F.col("s_did").alias("did"), F.col("s_th").alias("th"), F.struct("span", F.col("s_start").alias("start"), (F.col("s_start") + F.col("end") - F.col("start")).alias("end")).alias("x"))
    # a passage's first place may be asked for by very many spans: once for each range is enough
    source = written(source.groupBy("no_id", "did", "th", F.col("x.start").alias("start"), F.col("x.end").alias("end")).agg(F.min("x.span").alias("span")), "sources")
    asked = own.unionByName(source.select("no_id", "did", "th", F.struct((-1 - F.col("span")).alias("span"), "start", "end").alias("x")))
    asked = asked.groupBy("no_id", "did", "th").agg(F.collect_list("x").alias("asked")).withColumnsRenamed({"no_id": "_n", "did": "_d", "th": "_t"})
    same = (F.col("did") == F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("no_id") == F.col("_n"))
    read = written(_digests(_packed(keyed).join(asked, same)).groupBy("span").agg(F.min("digest").alias("digest")), "digests")
    first = source.join(read.filter("span < 0").select((-1 - F.col("span")).alias("span"), F.col("digest").alias("_first")), "span").select(F.col("no_id").alias("s_no"), F.col("did").alias("s_did"), F.col("th").alias("s_th"), F.col("start").alias("s_start"), (F.col("end") - F.col("start")).alias("_len"), "_first")
    rows = spans.withColumn("_len", F.col("end") - F.col("start")).join(first, ["s_no", "s_did", "s_th", "s_start", "_len"])
    return rows.join(read.filter("span >= 0"), "span").filter(F.col("digest") == F.col("_first")).drop("_len", "_first", "digest")


@settling("repeats")
def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(no_id, did, th, spans): word ranges (start, end) of each document that also start earlier."""
    repeated = written(repeated_anchors(keyed), "anchors")
    found = _anchors(keyed, False).join(repeated, "anchor")
    lists = found.groupBy("did").agg(*[F.collect_set(F.when(F.col("kind") == i, F.col("anchor"))).alias(c) for i, c in enumerate(("forks", "straight", "solid"))])
    units = written(_units(_packed(keyed).join(lists, "did")), "units")
    place = F.struct("no_id", "did", "th", "start")
    firsts = units.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest")).filter("n > 1").drop("n")
    later = units.join(written(firsts, "firsts"), ["anchor", "part"]).filter(place > F.col("earliest"))
    spans = written(_long_spans(later).withColumn("span", F.monotonically_increasing_id()), "spans")
    return verified(keyed, spans).groupBy("no_id", "did", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed), a row per input row.

    A word goes if a window of ``SPAN`` words that covers it also starts earlier: in a smaller id, or
    earlier in the same document. Words keep their letters; the kept ones are joined by one space. A
    null text has no words; a null id comes last; rows of equal id and text are one document and
    get equal results, and of equal id with different texts the order is that of a hash of the text. Other
    columns are ignored; an empty table gives no rows. A span whose texts turn out to differ (two hashes of
    64 bits met) stays.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed).withColumnsRenamed({"no_id": "_n", "did": "_d", "th": "_t"})
    same = (F.col("did") == F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("no_id") == F.col("_n"))
    rows = _packed(keyed).join(spans, same, "left").select("doc_id", "packed", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, out, size, first = zstandard.ZstdDecompressor(), [], 0, 0
            for i in range(batch.num_rows):
                own = z.decompress(batch.column(1)[i].as_py()).split()
                n = len(own)
                if batch.column(2)[i].is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, batch.column(2)[i].values.to_numpy(), 1)
                    np.add.at(gone, batch.column(3)[i].values.to_numpy(), -1)
                    own = [own[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                out.append((b" ".join(own), n, n - len(own)))
                size += len(out[-1][0])
                if size >= 8 << 20 or i + 1 == batch.num_rows:
                    text, count, removed = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(text, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept_text", "n_words", "n_removed"])
                    out, size, first = [], 0, i + 1

    return rows.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``without_repeats`` of all of ``documents``: counts and the digest of the kept words."""
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split_ AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM split_)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), words AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS x FROM split_
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split_ LEFT JOIN kept USING (doc_id)
"""
