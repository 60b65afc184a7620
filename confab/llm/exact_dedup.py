"""Exact dedup by deterministic block naming.

A text without its white space is cut into fixed-size blocks. Distinct blocks are sorted and get
integer names, their ranks; then adjacent pairs of names are named, and pairs of those, until one name
stands for the whole document. Two documents share level and name exactly when their squeezed texts are
equal. A block's text is shuffled once, keyed by a 128-bit hash that only routes and sorts it: the
smallest and the largest text of a key are compared, and keys holding different texts are named by text.
Names travel back to the blocks by key, so a hot block moves as many short rows. Ranks come from counts
of sorted buckets, so names don't depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm.common import settling, squeezed, table, written

BLOCK_CHARS = 4096
#: Sorted buckets whose sizes give the ranks that are names.
BUCKETS = 4096
#: A group with more than this part of all rows is broadcast; there are fewer such groups than this.
HOT = 1000
_KEY = ["doc_id", "chars", "digest"]
_NONE = -(2**63)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int, hash_bits: int) -> DataFrame:
    mask = (1 << hash_bits) - 1
    cut = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", F.length("text").cast("long").alias("chars"), squeezed(F.col("text")).alias("bare"))
        .select("doc_id", "chars", F.unhex(F.sha2("bare", 256)).alias("digest"), F.regexp_extract_all("bare", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("parts"))
    )
    parts = F.when(F.size("parts") == 0, F.array(F.lit(""))).otherwise(F.col("parts"))
    out = cut.select(*_KEY, F.greatest(F.size("parts"), F.lit(1)).alias("n"), F.posexplode(parts).alias("idx", "block"))
    key = F.xxhash64("block"), F.xxhash64(F.lit(1), F.col("block"))
    if hash_bits < 64:
        key = tuple(k.bitwiseAND(F.lit(mask)) for k in key)
    return out.withColumns({"h1": key[0], "h2": key[1]})


def ranked(rows: DataFrame, order: list[str], bucket: Column, label: str) -> DataFrame:
    """``rows`` (distinct, written) with ``name``: each row's rank by ``order``; ``bucket`` rises with it, below ``BUCKETS``.

    A rank is that inside the bucket after the sizes of the buckets before: at most ``BUCKETS`` counts are broadcast.
    """
    rows = written(rows.withColumn("bucket", bucket.cast("int")), label)
    counts = rows.groupBy("bucket").count()
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    return rows.withColumn("name", inside).join(F.broadcast(counts), "bucket").withColumn("name", F.col("before") + F.col("name")).drop("bucket", "before")


def _bucket_of(key: str) -> Column:
    """The bucket of a 64-bit hash, rising with it."""
    return F.shiftright(key, 65 - BUCKETS.bit_length()) + BUCKETS // 2


def _level(seq: DataFrame, level: int) -> DataFrame:
    """Names each adjacent pair of ``seq``; an odd last name pairs with nothing.

    Pairs are ranked by a hash of both names, then by the names: pairs that share a first block, as under one
    site header, are dealt over all buckets.
    """
    even = F.col("idx") % 2 == 0
    pairs = seq.groupBy(*_KEY, "rows", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NONE)).alias("right")
    )
    hashed = pairs.select("left", "right").distinct().withColumn("_h", F.xxhash64("left", "right"))
    names = written(ranked(hashed, ["_h", "left", "right"], _bucket_of("_h"), f"pairs{level}").drop("_h"), f"names{level}")
    return written(pairs.join(names, ["left", "right"]).select(*_KEY, "rows", "n", "idx", "name"), f"sequence{level}")


@settling("identities")
def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """(doc_id, chars, digest, rows, level, name): one row per id and text; (level, name) is its identity.

    ``rows`` counts repeated input rows of the same id, length and squeezed text. A null text is an
    empty one, a null id an id of its own. ``hash_bits`` below 64 provokes key clashes in tests.
    """
    occ = _blocks(docs, id_col, text_col, block_chars, hash_bits)
    by_key = occ.groupBy("h1", "h2").agg((F.min("block") == F.max("block")).alias("pure"))
    first = _bucket_of("h1") if hash_bits == 64 else F.lit(0)
    named = written(ranked(by_key, ["h1", "h2"], first, "keys"), "names0")
    cols = [*_KEY, "n", "idx", "name"]
    top = named.count()
    seq = occ.drop("block").join(named.filter("pure").drop("pure"), ["h1", "h2"]).select(*cols)
    clash = named.filter("not pure").select("h1", "h2")
    if not clash.isEmpty():
        mixed = occ.join(clash, ["h1", "h2"])
        texts = ranked(mixed.select("h1", "h2", "block").distinct(), ["block", "h1", "h2"], F.lit(0), "texts")
        seq = seq.unionByName(mixed.join(written(texts.withColumn("name", top + F.col("name")), "clashes"), ["h1", "h2", "block"]).select(*cols))
    seq = written(seq.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")), "sequence0")
    most = seq.agg(F.max("n")).first()[0] or 1
    done = []
    for level in range(max(1, int(most)).bit_length() + 1):
        done.append(seq.filter("n = 1").select(*_KEY, "rows", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        seq, most = _level(seq.filter("n > 1"), level + 1), (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal squeezed texts the row with the most code points, then the smallest id, stays; null ids
    come last. Of repeated rows of the id that stays, one is kept. An empty table gives no rows; other
    columns are ignored.

    Groups with more than one in ``HOT`` of all rows (fewer than ``HOT`` of them, whatever the input)
    are broadcast, so their rows meet no single task; the others are joined.
    """
    ids = identities(docs, id_col, text_col, **kw)
    best = F.min(F.struct((-F.col("chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    groups = written(ids.groupBy("level", "name").agg(F.sum("rows").alias("group_size"), best.alias("best"), F.count(F.lit(1)).alias("members")), "groups")
    hot = groups.filter(F.col("members") > max(100, ids.count() // HOT)).drop("members")
    one = ids.join(F.broadcast(hot), ["level", "name"])
    rest = ids.join(F.broadcast(hot), ["level", "name"], "left_anti").join(groups.drop("members"), ["level", "name"])
    one = one.unionByName(rest.select(*one.columns)).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.neg")) & (F.col("nth") == 1)
    return one.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text) without the rows that ``exact_groups`` drops; columns unchanged, cases as there.

    Of equal rows, one stays; of one id with texts that differ in white space only, the longest.
    """
    groups = exact_groups(docs)
    kept = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    marked = docs.withColumn("_digest", F.sha2(squeezed(F.coalesce(F.col("text"), F.lit(""))), 256)).withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)))
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    repeated = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).count().filter("count > 1").drop("count")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    if repeated.isEmpty():
        return joined.drop("_digest", "_chars")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(F.desc("_chars"), "text"))
    first = joined.join(repeated, same, "left_semi").withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return joined.join(repeated, same, "left_anti").unionByName(first).drop("_digest", "_chars")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_groups`` of all of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), grouped AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""
