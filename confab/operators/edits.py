"""Pairs of words within few edits, or of which one begins the other, by equal joins.

Two words within k edits become equal when each loses k letters at most: the letters that differ. A word's
keys are hashes of what is left of it after every choice of letters to lose, so pairs meet on keys,
not on lengths, and what meets is nearly what matches. Longer words, that could lose letters in too many ways, are
cut into one piece more than edits are allowed: a piece stays whole, near its place. Edit distances are
worked out once for each pair that met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.sources.storage import written

#: Letters up to which words meet by what is left of them, and up to which by pieces; the few longer ones meet by length.
SHORT, LONG = 10, 32


def _keyed(words: DataFrame, name: str, most: Callable[[Column], Column]) -> DataFrame:
    """(word, _k): hashes of what is left after ``most`` letters (2 at most) are lost, and fewer; a word may have a key twice.

    ``_i`` and ``_j`` are the lost letters' places, 0 for none: rows rather than arrays, so that all of it is compiled.
    """
    n, m, i, j = F.length(name), most(F.length(name)), F.col("_i"), F.col("_j")
    rows = words.select(name, F.explode(F.sequence(F.lit(0), F.when(m >= 2, n).otherwise(0))).alias("_i"))
    rows = rows.select(name, "_i", F.explode(F.sequence(F.when(i == 0, 0).otherwise(F.least(i + 1, n)), F.when(m >= 1, n).otherwise(0))).alias("_j")).filter((i == 0) | (j > i))
    part = lambda a, b: F.substring(F.col(name), a, F.greatest(b - a, F.lit(0)))
    left = F.concat(part(F.lit(1), i), part(i + 1, j), part(F.greatest(i, j) + 1, n + 1))
    return rows.select(name, F.xxhash64(F.when(j == 0, F.col(name)).otherwise(left)).alias("_k"))


def vocabulary(words: DataFrame) -> DataFrame:
    """Distinct words as a written table, dealt over as many files as a shuffle has parts: small as it is, much is made of each word."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(words.distinct().repartition(parts, *words.columns), "vocabulary")


def share_edits(share: float) -> Callable[[Column], Column]:
    """Edits that ``share`` of a word's letters allows; the added part keeps whole results whole in doubles."""
    return lambda n: F.floor(n * share + 1e-9).cast("int")


def edit_pairs(words: DataFrame, asked: DataFrame, most: Callable[[Column], Column], least_w: int = 1, least_q: int = 1, widest: float = 0.0) -> DataFrame:
    """(w, q, edits): pairs of ``words`` (w) and ``asked`` (q), both distinct, within ``most`` (longer length) edits.

    ``most`` may grow by one at most from one length to the next, as any share of the length does, so that a word never loses
    more letters than its own length allows. It is 2 at most up to SHORT letters; ``widest`` is the share that bounds it beyond
    (0: it is 2 there).
    """
    w, q = words.filter(F.length("w") >= least_w), asked.filter(F.length("q") >= least_q)
    short = _keyed(w.filter(F.length("w") <= SHORT), "w", most).join(_keyed(q.filter(F.length("q") <= SHORT), "q", most), "_k").select("w", "q").distinct()
    long_ = w.filter((F.length("w") > SHORT - 4) & (F.length("w") <= LONG))
    by_piece = _pieced(long_, widest).join(_piece_places(q.filter(F.length("q") <= LONG), most, widest), "_k").select("w", "q").distinct()
    by_piece = by_piece.filter(F.greatest(F.length("w"), F.length("q")) > SHORT)
    reach = q.withColumn("_n", F.length("q")).withColumn("_m", most(F.col("_n") * (2 if widest == 0 else 1 / (1 - widest))))
    reach = reach.select("q", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - F.col("_m")), F.col("_n") + F.col("_m"))).alias("_l")).filter((F.length("q") > LONG) | (F.col("_l") > LONG))
    by_length = w.withColumn("_l", F.length("w")).join(reach, "_l").select("w", "q")
    allowed = most(F.greatest(F.length("w"), F.length("q")))
    pairs = short.unionByName(by_piece).unionByName(by_length).withColumn("_m", allowed)
    return pairs.withColumn("edits", F.levenshtein("w", "q")).filter(F.col("edits") <= F.col("_m")).select("w", "q", "edits")


def _most_of(length: Column, widest: float) -> Column:
    """Edits to any partner that a word of ``length`` may have."""
    return F.lit(2) if widest == 0 else F.floor(length * (widest / (1 - widest)) + 1e-9).cast("int")


def _bounds(length: Column, parts: Column, j: Column) -> tuple[Column, Column]:
    """Where piece ``j`` of a word of ``length`` begins and ends, of ``parts`` even ones."""
    return F.floor(j * length / parts).cast("int"), F.floor((j + 1) * length / parts).cast("int")


def _pieced(words: DataFrame, widest: float) -> DataFrame:
    n = F.length("w")
    parts = _most_of(n, widest) + 1

    def key(j: Column) -> Column:
        a, b = _bounds(n, parts, j)
        return F.xxhash64(n, j, F.substring(F.col("w"), a + 1, b - a))

    return words.select("w", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), key)).alias("_k"))


def _piece_places(asked: DataFrame, most: Callable[[Column], Column], widest: float) -> DataFrame:
    """Keys of the pieces that a partner may have in common with q: its length, the piece's number, what q has near the piece's place."""
    n = F.length("q")
    least = F.ceil(n * (1 - widest) - 1e-9).cast("int") if widest else n - 2
    longest = F.least(F.lit(LONG), F.floor(n / (1 - widest) + 1e-9).cast("int") if widest else n + 2)
    rows = asked.select("q", F.explode(F.sequence(F.least(F.greatest(least, F.lit(1)), longest), longest)).alias("_l")).filter((F.col("_l") > SHORT - 4) & (F.greatest(F.col("_l"), n) > SHORT))
    l = F.col("_l")
    rows = rows.withColumn("_p", _most_of(l, widest) + 1).withColumn("_m", most(F.greatest(l, n)))
    rows = rows.select("q", "_l", "_p", "_m", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_j"))
    a, b = _bounds(l, F.col("_p"), F.col("_j"))
    rows = rows.select("q", "_l", "_j", (b - a).alias("_s"), F.explode(F.sequence(F.greatest(F.lit(0), a - F.col("_m")), F.greatest(F.lit(0), a + F.col("_m")))).alias("_a"))
    return rows.filter(F.col("_a") + F.col("_s") <= F.length("q")).select("q", F.xxhash64("_l", "_j", F.substring(F.col("q"), F.col("_a") + 1, F.col("_s"))).alias("_k")).distinct()


def prefix_pairs(words: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(w, q): w begins with q, which has ``least`` letters at least. Beginnings of up to LONG letters meet, longer queries are compared on."""
    heads = words.select("w", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.length("w"), F.lit(LONG))))).alias("_n"))
    heads = heads.filter(F.col("_n") <= F.length("w")).select("w", F.xxhash64(F.expr("substring(w, 1, _n)")).alias("_k"))
    keyed = asked.filter(F.length("q") >= least).select("q", F.xxhash64(F.substring("q", 1, LONG)).alias("_k"))
    return heads.join(keyed, "_k").filter(F.col("w").startswith(F.col("q"))).select("w", "q")
