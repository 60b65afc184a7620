"""URL filters: exact membership in rule lists by cascades of Bloom filters.

A url's keys are its host's suffixes joined with its path's prefixes, of the shapes that the rules
have. The distinct keys of the whole corpus are the key universe. The first filter of a cascade
encodes the listed keys, the second the universe's false positives of the first, the third the
listed keys that the second wrongly passes, and so on until none is left: then membership is exact
for every key of the universe, decided by bit tests inside the scan, without a join. A cascade's
size follows the number of listed keys that the corpus has; beyond ``MAX_LISTED`` the same membership
comes from a join of the distinct hosts and paths with the rules.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import table, written

#: Listed keys of a cascade that may be broadcast with the plan; about 2 bytes each.
MAX_LISTED = 1_000_000
_SALTS = 16
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: str) -> list[str]:
        return [f"pmod(xxhash64({key}, {self.seed}, {j}), {self.bits}L)" for j in range(self.hashes)]

    def passes(self, key: str) -> str:
        """SQL condition on the SQL expression ``key``."""
        words = f"from_json('{json.dumps(self.words)}', 'array<bigint>')"
        return "(" + " AND ".join(f"(shiftright(get({words}, cast({p} div 64 AS int)), cast({p} % 64 AS int)) & 1) = 1" for p in self.positions(key)) + ")"


def bloom(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """Filter over ``keys`` (key), ``count`` of them, with about ``rate`` false positives."""
    rate = min(0.5, max(rate, 1e-6))
    bits = 64 * max(1, math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
    empty = Level((), bits, max(1, round(-math.log2(rate))), seed)
    found = keys.select(F.explode(F.array(*[F.expr(p) for p in empty.positions("key")])).alias("at")).groupBy(F.expr("cast(at div 64 AS int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    words = [0] * (bits // 64)
    for r in found.collect():  # at most bits / 64 rows, bounded by the listed keys
        words[r.word] = r.bits
    return Level(tuple(words), bits, empty.hashes, seed)


def cascade(universe: DataFrame, listed: DataFrame, label: str, most: int = MAX_LISTED) -> list[Level] | None:
    """Levels that tell exactly which keys of ``universe`` (key) are in ``listed`` (key); None beyond ``most`` of them."""
    inside = written(universe.join(listed, "key", "left_semi"), f"{label}-in")
    n_in = inside.count()
    if n_in > most:
        return None
    outside, n_all = universe.join(listed, "key", "left_anti"), universe.count()
    levels: list[Level] = []
    encode, test, n = inside, outside, n_in
    rate = n_in / (math.sqrt(2) * max(1, n_all - n_in))
    while n:
        levels.append(bloom(encode, n, rate, 2 * len(levels) + 1))
        wrong = written(test.filter(F.expr(levels[-1].passes("key"))), f"{label}-{len(levels)}")
        n, rate = wrong.count(), 0.5
        encode, test = wrong, encode
    return levels


def contains(levels: list[Level], key: str) -> str:
    """SQL condition: the first level that a key fails decides; even levels list wrong passes."""
    said = "true" if len(levels) % 2 else "false"
    for i in range(len(levels) - 1, -1, -1):
        said = f"(CASE WHEN {levels[i].passes(key)} THEN {said} ELSE {'true' if i % 2 else 'false'} END)"
    return said


def as_table(spark: SparkSession, rules) -> DataFrame:
    """(key, verdict): ``rules`` as a table (verdict, host, path) or such tuples; a key under both verdicts is in both."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return rules.filter("verdict in ('allow', 'block')").select(F.concat("host", "path").alias("key"), "verdict", "host", "path").filter("key is not null")


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow", most: int = MAX_LISTED) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages`` (replacing such columns).

    ``rules`` are (verdict, host, path), tuples or a table of any size; rules of another verdict or with
    a null take no part. A rule fits its host and all subdomains whose path starts with the rule's; the
    longest wins, of equal length that with the longer host, then a block. Where none fits, rule is null
    and the verdict is ``default``: the url's keys are not listed. A null url or one without ``://`` has
    an empty host and path. Repeated rows are judged alike; an empty table gives no rows.

    Only the distinct shapes of rules (labels of a host, characters of a path: a few hundred pairs) and
    cascades of up to ``most`` keys reach the driver.
    """
    listed = as_table(pages.sparkSession, rules)
    parsed = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    shapes = sorted((r.labels, r.n) for r in listed.select((F.regexp_count("host", F.lit("[.]")) + 1).alias("labels"), F.length("path").alias("n")).distinct().collect())
    parts = ", ".join(f"CASE WHEN length(path) >= {n} THEN concat(substring_index(host, '.', -{labels}), left(path, {n})) END" for labels, n in shapes)
    with_keys = lambda df: df.withColumn("_keys", F.expr(f"array_distinct(array_compact(array({parts})))") if shapes else F.array().cast("array<string>"))
    keyed = with_keys(parsed)
    universe = written(keyed.select(F.explode("_keys").alias("key")).distinct(), "url-keys")
    hit = "named_struct('n', length(k), 'h', length(substring_index(k, '/', 1)), 'verdict', '{0}', 'rule', k)"
    levels = {v: cascade(universe, listed.filter(F.col("verdict") == v).select("key").distinct(), v, most) for v in ("allow", "block")}
    if None in levels.values():
        own = listed.select("key", F.struct(F.length("key").alias("n"), F.length(F.substring_index("key", "/", 1)).alias("h"), "verdict", F.col("key").alias("rule")).alias("_hit")).distinct()
        places = with_keys(parsed.select("host", "path").distinct()).select("host", "path", F.explode("_keys").alias("key"))
        best = places.join(own, "key").groupBy("host", "path").agg(F.max("_hit").alias("_best"))
        salts = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a url that stands in a third of all rows meets several tasks
        best = parsed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")).join(salts, ["host", "path", "_salt"], "left")
    else:
        found = [f"transform(filter(_keys, k -> {contains(v, 'k')}), k -> {hit.format(name)})" for name, v in levels.items()]
        best = keyed.withColumn("_best", F.expr(f"array_max(concat({', '.join(found)}))"))
    best = best.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
    return best.select(*parsed.columns, *[c for c in ("rule", "verdict") if c not in parsed.columns])


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge_urls`` of all of ``pages`` by ``RULES``."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
