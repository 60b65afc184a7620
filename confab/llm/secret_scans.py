"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns give spans in code points: what ``split`` leaves between the matches gives their
places. Weak parts (a user or client name, an unlabelled mixed token, an endpoint) are reported only
where complementary parts lie within ``SCOPE`` code points in the same document: an interval join of
parts with per-bin summaries of identifiers and secrets, so its rows grow with the parts, not with
their pairs. Parts are disjoint, so none vouches for itself: a weak part that overlaps a base span
goes, a weak secret that overlaps a weak identifier is its value, and an endpoint that overlaps either
only holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.llm.common import table, written

SCOPE = 200
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: kind, pattern, group whose length counts, least length, role
BASE = (("assign", ASSIGN, 2, 6, "secret"), ("access", ACCESS, 0, 20, "id"), ("hex", HEX, 0, 24, "secret"))
WEAK = (
    ("weak_id", r"""(?i:user|username|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "id"),
    ("weak_secret", r"(?<![A-Za-z0-9+/_])(?=[A-Za-z+/_]*+[0-9])(?=[A-Z0-9+/_]*+[a-z])(?=[a-z0-9+/_]*+[A-Z])[A-Za-z0-9+/_]{20,}", "secret"),
    ("weak_endpoint", r"""(?:https?|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", "endpoint"),
)
KINDS = [x[0] for x in BASE] + [x[0] for x in WEAK]
_SPAN = "struct<start:int,nth:int,end:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, nth: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array of (start, nth, end): leftmost non-overlapping matches whose ``group`` has ``least`` code points.

    Places are running sums of gaps and sizes, in blocks of about the square root of their number:
    an array that grew match by match would be copied at each.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(hits, F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), counted.alias("counted"))
    none = F.array().cast(f"array<{_SPAN}>")
    span = lambda start, end: F.struct(start.alias("start"), F.lit(nth).alias("nth"), end.alias("end"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(row["size"], F.lit(0))
        return F.struct(end.alias("at"), F.when(row["counted"] >= least, F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"]).alias("out"))

    def block(rows: Column, at: Column, size: Column) -> Column:
        return F.aggregate(F.slice(rows, at + 1, size), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(done: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(done, zero, lambda a, d: F.struct((a["at"] + d["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(done, offsets, lambda d, o: F.transform(d["out"], lambda s: span(s["start"] + o, s["end"] + o))))

    def summed(rows: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(rows))).cast("int"))
        return _let(size, lambda n: _let(F.transform(F.sequence(F.lit(0), F.size(rows) - 1, n), lambda at: block(rows, at, n)), placed))

    return F.when(text.rlike(pattern), _let(rows, summed)).otherwise(none)


def disjoint(parts: DataFrame) -> DataFrame:
    """``parts`` (key, role, weak, start, nth, end) without weak ones that overlap a part that outranks them.

    Base spans outrank all, weak identifiers weak secrets and endpoints, weak secrets endpoints. One
    sorted pass: at a part's end, the furthest end of what began before tells.
    """
    both = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("end").alias("at"), F.lit(0).alias("turn")))
    sweep = Window.partitionBy("key").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda which: F.coalesce(F.max(F.when((F.col("turn") == 1) & which, F.col("end"))).over(sweep), F.lit(0)) <= F.col("start")
    weak, role = F.col("weak"), F.col("role")
    rows = parts.select("*", F.explode(both).alias("_e")).select(*parts.columns, "_e.*")
    rows = rows.withColumns({"_base": before(~weak), "_id": before(weak & (role == "id")), "_secret": before(weak & (role == "secret"))})
    free = ~weak | (F.col("_base") & ((role == "id") | F.col("_id")) & ((role != "endpoint") | F.col("_secret")))
    return rows.filter((F.col("turn") == 0) & free).select(*parts.columns)


def _near(role: str) -> Column:
    """Whether a part of ``role`` starts within SCOPE of ``start``, from the summary of its bin and the two beside."""
    return (F.col(f"{role}_before") >= F.col("start") - SCOPE) | F.col(f"{role}_here") | (F.col(f"{role}_after") <= F.col("start") + SCOPE)


def linked(parts: DataFrame) -> DataFrame:
    """Weak ``parts`` (key, role, weak, start, nth, end) with complementary parts in scope.

    A weak identifier needs a secret, a weak secret an identifier, an endpoint both; strong parts count too.
    """
    bins = parts.filter("role <> 'endpoint'").groupBy("key", "role", F.expr(f"start div {SCOPE}").alias("bin")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    bins = bins.select("key", "role", "low", "high", F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.lit(d).alias("by")) for d in (-1, 0, 1)])).alias("to")).select("key", "role", "low", "high", "to.*")
    aggs = []
    for role in ("id", "secret"):
        own = F.col("role") == role
        aggs += [
            F.max(F.when(own & (F.col("by") == 1), F.col("high"))).alias(f"{role}_before"),
            F.coalesce(F.bool_or(own & (F.col("by") == 0)), F.lit(False)).alias(f"{role}_here"),
            F.min(F.when(own & (F.col("by") == -1), F.col("low"))).alias(f"{role}_after"),
        ]
    scopes = bins.groupBy("key", "bin").agg(*aggs)
    weak = parts.filter("weak").withColumn("bin", F.expr(f"start div {SCOPE}")).join(scopes, ["key", "bin"])
    has_id, has_secret = F.coalesce(_near("id"), F.lit(False)), F.coalesce(_near("secret"), F.lit(False))
    return weak.filter(F.when(F.col("role") == "id", has_secret).when(F.col("role") == "secret", has_id).otherwise(has_id & has_secret)).select("key", "start", "nth", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans), a row per input row; both are arrays of (kind, start, end) by start, then kind.

    A null text is empty and has no spans, a null id is an id. Repeated rows get equal spans; rows of
    one id with different texts are separate documents. Other columns are ignored. An empty table gives
    no rows. Time grows about with the number of matches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cols = {"key": F.struct(F.col("doc_id"), F.unhex(F.md5("text")).alias("md5"))}
    for i, (kind, pattern, group, least, _) in enumerate(BASE):
        cols[kind] = _spans(F.col("text"), i, pattern, group, least)
    for i, (kind, pattern, _) in enumerate(WEAK, len(BASE)):
        cols[kind] = _spans(F.col("text"), i, pattern)
    found = rows.select("doc_id", *[c.alias(k) for k, c in cols.items()])
    base = F.array_sort(F.concat(*[F.col(x[0]) for x in BASE]))
    weak = F.concat(*[F.col(x[0]) for x in WEAK])
    found = written(found.select("doc_id", "key", base.alias("base"), weak.alias("weak")), "spans")
    roles = F.element_at(F.array(*[F.lit(x[-1]) for x in (*BASE, *WEAK)]), F.col("nth") + 1)
    parts = found.filter("size(weak) > 0").select("key", "base", "weak").dropDuplicates(["key"]).select("key", F.explode(F.concat("base", "weak")).alias("span"))
    parts = disjoint(parts.select("key", "span.*").withColumns({"role": roles, "weak": F.col("nth") >= len(BASE)}))
    more = linked(written(parts, "parts")).groupBy("key").agg(F.collect_set(F.struct("start", "nth", "end")).alias("more"))
    more = more.select(F.col("key.doc_id").alias("_id"), F.col("key.md5").alias("_md5"), "more")
    out = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key.md5") == F.col("_md5")), "left")
    named = lambda spans: F.transform(spans, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["nth"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))
    return out.select("doc_id", named(F.col("base")).alias("base"), named(both).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: counts and digests of the base spans, and all spans as text; cases as in ``scan_secrets``."""
    rows = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in KINDS[: len(BASE)]]
    return rows.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
