"""Queries over texts and retrieval and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions import sql
from confab.functions import text as t
from confab.operators import retrieval as r
from confab.operators import text as x
from confab.operators.segments import by_id
from confab.plans.segment_queries import _base, _segs, _sql
from confab.sources import conversations as c

ASKED = ((1, "the notion of thing"), (2, "edition heather"), (3, "unter einer verheit"))


def _docs(segs):
    return segs.select((F.col("recording_id") * 1000 + F.col("seg_id")).alias("doc_id"), "text")


def _queries(spark):
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in ASKED])).alias("q")).select("q.*")


def _search(op):
    return lambda spark, d: op(_docs(_base(spark, d)[1]), _queries(spark))


def _folded_columns(segs):
    prev = F.lag("text").over(by_id())
    return segs.select("recording_id", "seg_id", t.folded(F.col("text")).alias("folded"), F.coalesce(t.is_repetition(F.col("text"), prev), F.lit(False)).alias("repetition"), t.is_word_run(F.col("text")).alias("word_run"), t.clock(F.col("start_ms")).alias("clock"))


def _translated(segs):
    """Replies translate the first five lines of each batch, and every fourth reply is broken."""
    batches = x.translation_batches(segs)
    k = F.row_number().over(Window.partitionBy("recording_id", "batch_id").orderBy("seg_id"))
    rows = segs.join(batches, ["recording_id", "seg_id"]).withColumn("k", k).filter("k <= 5").groupBy("recording_id", "batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: F.concat(F.lit("PL "), s["text"])).alias("l"))
    reply = F.when((F.col("recording_id") + F.col("batch_id")) % 4 == 3, "{broken").otherwise(F.to_json(F.struct(F.col("l").alias("tlumaczenia_pl"))))
    return x.aligned(segs, batches, rows.select("recording_id", "batch_id", reply.alias("reply")))


def _entities(segs):
    w = c.words(segs).filter("length(word) > 8")
    kind = F.when(F.length("word") > 12, "keyword").when(F.length("word") > 10, "person").otherwise("place")
    return w.select("recording_id", F.expr("seg_id div 10").alias("window"), kind.alias("kind"), (F.col("seg_id") * 1000 + F.col("word_idx")).alias("pos"), F.concat(F.lit(" "), "word", F.lit(" ")).alias("value"))


def _list(df):
    return df.withColumn("values", F.array_join("values", "|"))


def in_recordings(vectors):
    """All of ``vectors`` with a recording_id: 20 ids in a row are the voices of a recording."""
    return vectors.withColumn("recording_id", F.expr("vec_id div 20"))


def _voices(spark, d):
    v = in_recordings(c.table(spark, d, "embeddings").select("vec_id", "embedding"))
    return r.near_labels(v.withColumnRenamed("recording_id", "label"), 0.2).withColumnRenamed("label", "recording_id")


def _searches(spark, d):
    """All vectors, and every fiftieth id as the queries."""
    v = c.table(spark, d, "embeddings").select("vec_id", "embedding")
    return v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _texts(spark, d):
    """The entries' texts (the documents of the same ids); a search asks the first six words of its own."""
    texts = c.table(spark, d, "documents").select("doc_id", "text").join(c.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    asked = texts.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"))
    return texts, asked


def _hybrid(spark, d, k=8):
    return r.hybrid_search(*_searches(spark, d), *_texts(spark, d), k)


def _mmr(spark, d):
    return r.mmr(_hybrid(spark, d, 24).drop("rank").join(_searches(spark, d)[0], "vec_id"))


def _by_name(query):
    """A query in SQL that calls the engine's functions by name."""

    def run(spark, d):
        sql.register(spark)
        return spark.sql(query, segs=_base(spark, d)[1])

    return run


QUERIES = {
    "text_functions": _segs(_folded_columns),
    "sql_functions": _by_name("SELECT w, phonetic_key(w) AS key, clock_text(max(end_ms)) AS latest, count(*) AS n FROM (SELECT end_ms, explode(ws) AS w FROM (SELECT end_ms, word_tokens(text, 3) AS ws FROM {segs})) GROUP BY w"),
    "sql_windows": _by_name("SELECT recording_id, seg_id, window_no, fold_text(chunk) AS chunk FROM {segs} s, LATERAL text_windows(text, 200, 20) w"),
    "phonetic_keys": _segs(lambda s: s.select(F.explode(F.array_distinct(t.tokens(F.col("text"), 1))).alias("w")).filter("w <> ''").distinct().withColumn("key", t.phonetic_key(F.col("w")))),
    "translation_batches": _segs(x.translation_batches),
    "numbered_blocks": _segs(lambda s: x.numbered_blocks(s, x.translation_batches(s))),
    "translation_alignment": _segs(_translated),
    "char_windows": _segs(lambda s: x.char_windows(x.transcripts(s))),
    "entity_union_sorted": _segs(lambda s: _list(x.merged_entities(_entities(s)))),
    "entity_union_ordered": _segs(lambda s: _list(x.merged_entities(_entities(s), keep_order=True))),
    "export_text": _segs(lambda s: x.exported(s.withColumn("text_pl", F.when(F.col("seg_id") % 2 == 0, F.concat(F.lit("PL "), "text")).otherwise("")))),
    "topic_windows": _segs(x.topic_windows),
    "chunk_sliding": _segs(x.sliding_chunks),
    "keyword_scores": _search(r.keyword_scores),
    "keyword_topk": _search(lambda d, q: r.top_k(r.keyword_scores(d, q), 8)),
    "text_search_kinds": _search(r.word_match),
    "vector_topk": lambda spark, d: r.nearest_rows(*_searches(spark, d), 8).withColumnRenamed("score", "cosine"),
    "hybrid_topk": _hybrid,
    "mmr_rerank": _mmr,
    "speaker_similarity": _voices,
}

_FOLD = r"trim(regexp_replace(translate(lower({0}), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = r"list_filter(string_split(" + _FOLD + r", ' '), lambda q: length(q) >= {1})"
_BATCH = """f AS (SELECT recording_id, seg_id, length(text) AS len FROM segments), batched AS (
  SELECT recording_id, seg_id, 0 AS batch_id, 1 AS n, len AS c FROM f WHERE seg_id = 0
  UNION ALL
  SELECT f.recording_id, f.seg_id, CASE WHEN b.n >= 15 OR b.c >= 3000 THEN b.batch_id + 1 ELSE b.batch_id END, CASE WHEN b.n >= 15 OR b.c >= 3000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 15 OR b.c >= 3000 THEN f.len ELSE b.c + f.len END
  FROM batched b JOIN f ON f.recording_id = b.recording_id AND f.seg_id = b.seg_id + 1)"""
_LINED = "lined AS (SELECT s.*, b.batch_id, row_number() OVER (PARTITION BY s.recording_id, b.batch_id ORDER BY s.seg_id) AS k FROM segments s JOIN batched b USING (recording_id, seg_id))"
_FOUND = "found AS (SELECT recording_id, seg_id // 10 AS window_, seg_id * 1000 + word_idx AS pos, word, CASE WHEN length(word) > 12 THEN 'keyword' WHEN length(word) > 10 THEN 'person' ELSE 'place' END AS kind FROM words WHERE length(word) > 8)"
_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") v(query_id, query))"
_DT = "d AS (SELECT recording_id * 1000 + seg_id AS doc_id, " + _WORDS.format("text", 3) + " AS ts FROM segments), dt AS (SELECT DISTINCT doc_id, len(ts) AS n, unnest(ts) AS w FROM d), q AS (SELECT query_id, " + _WORDS.format("query", 3) + " AS qs FROM asked), qt AS (SELECT query_id, len(qs) AS total, generate_subscripts(qs, 1) AS i, unnest(qs) AS q FROM q)"
_KW = """hits AS (
  SELECT query_id, doc_id, i, n, total, max(sim) AS sim FROM (SELECT *, CASE WHEN starts_with(w, q) OR starts_with(q, w) THEN 1.0 WHEN length(q) >= 4 AND length(w) >= 3 AND levenshtein(q, w) <= 2 THEN 1 - levenshtein(q, w)::DOUBLE / greatest(length(q), length(w)) ELSE 0 END::DOUBLE AS sim FROM dt, qt) WHERE sim > 0.6 GROUP BY ALL),
kw AS (SELECT query_id, doc_id, round(least(1.0, s / (m * total)) * matched / total, 6) AS score FROM (SELECT query_id, doc_id, total, sum(sim * 2.5::DOUBLE / (sim + l) * sim) AS s, count(*) AS matched, max(2.5::DOUBLE / (1 + l)) AS m FROM (SELECT *, 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 60) AS l FROM hits) GROUP BY ALL))"""
_KEY = r"regexp_replace({0}, '[aeiou]', '', 'g')"
_SQUEEZE = "list_reduce(list_transform(string_split({0}, ''), lambda ch: ch), lambda a, b: CASE WHEN right(a, 1) = b THEN a ELSE a || b END)"
_PHON = _KEY.format(_SQUEEZE.format("replace(replace(replace(replace(replace(replace({0}, 'rz', 'z'), 'ch', 'h'), 'sz', 's'), 'cz', 'c'), 'dz', 'z'), 'dz', 'z')"))
_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"""nv AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e / sqrt({_DOT.format('embedding', 'embedding')})) AS v FROM embeddings),
cos AS (SELECT a.vec_id AS query_id, b.vec_id, round({_DOT.format('a.v', 'b.v')}, 6) AS cosine FROM nv a, nv b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""

_CHUNKS = """f AS (SELECT recording_id, seg_id, length(text) AS l0, coalesce(lag(length(text), 1) OVER w, 0) AS l1, coalesce(lag(length(text), 2) OVER w, 0) AS l2 FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id)),
walk AS (SELECT recording_id, seg_id, 0 AS chunk_id, 0 AS first_, 1 AS n, l0 AS c FROM f WHERE seg_id = 0
  UNION ALL SELECT f.recording_id, f.seg_id, CASE WHEN k.n >= 3 AND k.c >= 600 THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN k.n >= 3 AND k.c >= 600 THEN greatest(0, f.seg_id - 2) ELSE first_ END,
    CASE WHEN k.n >= 3 AND k.c >= 600 THEN f.seg_id - greatest(0, f.seg_id - 2) + 1 ELSE k.n + 1 END, CASE WHEN k.n >= 3 AND k.c >= 600 THEN l0 + l1 + l2 ELSE k.c + l0 END
  FROM walk k JOIN f ON f.recording_id = k.recording_id AND f.seg_id = k.seg_id + 1),
chunks_ AS (SELECT recording_id, chunk_id, min(first_) AS first_idx, max(seg_id) AS last_idx FROM walk GROUP BY ALL)"""
_HYBRID = "WITH " + _COS + ", asked AS (SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), " + _DT.replace("SELECT recording_id * 1000 + seg_id AS doc_id", "SELECT doc_id").replace("FROM segments)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))") + ", " + _KW + """,
hybrid_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT c.query_id, c.vec_id, round(0.75::DOUBLE * cosine + 0.25::DOUBLE * coalesce(k.score, 0), 8) AS score FROM cos c LEFT JOIN kw k ON k.query_id = c.query_id AND k.doc_id = c.vec_id) WHERE score >= 0.15)"""

ORACLES = {
    "text_functions": _sql(
        "SELECT recording_id, seg_id, " + _FOLD.format("text") + r""" AS folded,
  coalesce(CASE WHEN len(b) = 0 OR len(pb) = 0 THEN trim(lower(text)) = trim(lower(prev)) ELSE len(list_intersect(b, pb)) >= 0.85 * len(list_distinct(list_concat(b, pb))) END, false) AS repetition,
  len(ws) >= 5 AND top >= 5 AND top * 10 > len(ws) * 7 AS word_run, (start_ms // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock
FROM (SELECT *, lag(text) OVER w AS prev, lag(b) OVER w AS pb, coalesce(list_max(list_transform(list_distinct(ws), lambda y: len(list_filter(ws, lambda z: z = y)))), 0) AS top
  FROM (SELECT *, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS b FROM (SELECT *, regexp_split_to_array(trim(lower(text)), '\s+') AS l, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+'), lambda y: y <> '') AS ws FROM segments))
  WINDOW w AS (PARTITION BY recording_id ORDER BY seg_id))"""
    ),
    "sql_functions": _sql("SELECT w, " + _PHON.format("w") + " AS key, (max(end_ms) // 60000) || ':' || lpad(CAST(max(end_ms) // 1000 % 60 AS VARCHAR), 2, '0') AS latest, count(*) AS n FROM (SELECT end_ms, unnest(" + _WORDS.format("text", 3) + ") AS w FROM segments) GROUP BY w"),
    "sql_windows": _sql("SELECT recording_id, seg_id, CAST(i AS INT) AS window_no, " + _FOLD.format("substr(text, i * 180 + 1, 200)") + " AS chunk FROM segments JOIN range(0, 10000) g(i) ON i = 0 OR (length(text) > 200 AND i * 180 < length(text))"),
    "phonetic_keys": _sql("SELECT w, " + _PHON.format("w") + " AS key FROM (SELECT DISTINCT unnest(" + _WORDS.format("text", 1) + ") AS w FROM segments) WHERE w <> ''"),
    "translation_batches": _sql("SELECT recording_id, seg_id, batch_id FROM batched", _BATCH).replace("WITH ", "WITH RECURSIVE ", 1),
    "numbered_blocks": _sql("SELECT recording_id, batch_id, count(*) AS n, string_agg(k || '. [' || speaker || '] ' || text, chr(10) ORDER BY k) AS block FROM lined GROUP BY ALL", _BATCH, _LINED).replace("WITH ", "WITH RECURSIVE ", 1),
    "translation_alignment": _sql("SELECT recording_id, seg_id, CASE WHEN k <= 5 AND (recording_id + batch_id) % 4 <> 3 THEN 'PL ' || text ELSE text END AS text_pl FROM lined", _BATCH, _LINED).replace("WITH ", "WITH RECURSIVE ", 1),
    "char_windows": _sql("SELECT recording_id, CAST(i AS INT) AS window, substr(t, CAST(i * 5400 + 1 AS INT), 6000) AS chunk FROM (SELECT recording_id, t, unnest(CASE WHEN length(t) <= 6000 THEN [0] ELSE range(least(6, (length(t) - 1) // 5400 + 1)) END) AS i FROM (SELECT recording_id, string_agg(text, ' ' ORDER BY seg_id) AS t FROM segments GROUP BY ALL))"),
    "entity_union_sorted": _sql("SELECT recording_id, kind, array_to_string(CASE WHEN kind = 'keyword' THEN l[1:20] ELSE l END, '|') AS values FROM (SELECT recording_id, kind, list_sort(list(DISTINCT word)) AS l FROM found GROUP BY ALL)", _FOUND),
    "entity_union_ordered": _sql("SELECT recording_id, kind, array_to_string(CASE WHEN kind = 'keyword' THEN l[1:20] ELSE l END, '|') AS values FROM (SELECT recording_id, kind, list(word ORDER BY window_, pos) AS l FROM (SELECT recording_id, kind, word, min(window_) AS window_, min(pos) AS pos FROM found GROUP BY ALL) GROUP BY ALL)", _FOUND),
    "export_text": _sql("SELECT recording_id, string_agg('[' || (start_ms // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || ' - ' || (end_ms // 60000) || ':' || lpad(CAST(end_ms // 1000 % 60 AS VARCHAR), 2, '0') || '] ' || speaker || ': ' || CASE WHEN seg_id % 2 = 0 THEN 'PL ' || text || chr(10) || '  (' || text || ')' ELSE text END, chr(10) ORDER BY seg_id) AS export FROM segments GROUP BY ALL"),
    "topic_windows": _sql(
        "SELECT recording_id, win_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, substr(string_agg(text, ' ' ORDER BY seg_id), 1, 1000) AS text FROM segments JOIN folded USING (recording_id, seg_id) WHERE win_id < 8 GROUP BY recording_id, win_id",
        """folded AS (SELECT recording_id, seg_id, 0 AS win_id, CAST(0 AS BIGINT) AS at_ FROM segments WHERE seg_id = 0
  UNION ALL SELECT s.recording_id, s.seg_id, CASE WHEN s.start_ms - at_ >= 300000 THEN win_id + 1 ELSE win_id END, CASE WHEN s.start_ms - at_ >= 300000 THEN s.start_ms ELSE at_ END FROM folded f JOIN segments s ON s.recording_id = f.recording_id AND s.seg_id = f.seg_id + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "chunk_sliding": _sql("SELECT c.recording_id, chunk_id, first_idx, last_idx, string_agg(text, ' ' ORDER BY s.seg_id) AS text FROM chunks_ c JOIN segments s ON s.recording_id = c.recording_id AND s.seg_id BETWEEN first_idx AND last_idx GROUP BY c.recording_id, chunk_id, first_idx, last_idx", _CHUNKS).replace("WITH ", "WITH RECURSIVE ", 1),
    "keyword_scores": _sql("SELECT * FROM kw", _ASKED, _DT, _KW),
    "keyword_topk": _sql("SELECT query_id, doc_id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM kw) WHERE r <= 8", _ASKED, _DT, _KW),
    "text_search_kinds": _sql(
        "SELECT query_id, doc_id, round(sum(m.s) / total, 6) AS score, CASE max(m.o) WHEN 3 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'phonetic' END AS kind FROM (SELECT query_id, doc_id, i, total, max(m) AS m FROM (SELECT *, CASE WHEN starts_with(w, q) THEN {'o': 3, 's': 1.0::DOUBLE} WHEN length(q) >= 4 AND length(w) >= 3 AND sim >= 0.72 THEN {'o': 2, 's': sim} WHEN length(q) >= 4 AND length(w) >= 4 AND length(qk) >= 2 AND qk = wk THEN {'o': 1, 's': 0.7::DOUBLE} END AS m FROM pairs) WHERE m IS NOT NULL GROUP BY query_id, doc_id, i, total) GROUP BY query_id, doc_id, total",
        _ASKED,
        "dw AS (SELECT DISTINCT recording_id * 1000 + seg_id AS doc_id, unnest(" + _WORDS.format("text", 1) + ") AS w FROM segments), qw AS (SELECT query_id, len(qs) AS total, generate_subscripts(qs, 1) AS i, unnest(qs) AS q FROM (SELECT query_id, " + _WORDS.format("query", 1) + " AS qs FROM asked))",
        "wp AS (SELECT w, q, 1 - levenshtein(q, w)::DOUBLE / greatest(length(q), length(w)) AS sim, " + _PHON.format("w") + " AS wk, " + _PHON.format("q") + " AS qk FROM (SELECT DISTINCT w FROM dw WHERE w <> ''), (SELECT DISTINCT q FROM qw WHERE q <> '')), pairs AS (SELECT * FROM dw JOIN wp USING (w) JOIN qw USING (q))",
    ),
    "vector_topk": "WITH " + _COS + " SELECT query_id, vec_id, cosine, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM cos) WHERE r <= 8",
    "hybrid_topk": _HYBRID + " SELECT query_id, vec_id, score, CAST(r AS INT) AS rank FROM hybrid_ WHERE r <= 8",
    "mmr_rerank": _HYBRID.replace("WITH ", "WITH RECURSIVE ", 1) + """, pool AS (SELECT query_id, h.vec_id, score, r, v, count(*) OVER (PARTITION BY query_id) AS n FROM hybrid_ h JOIN nv USING (vec_id) WHERE r <= 24),
walk AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(-1 AS BIGINT) AS vec_id, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS chosen FROM (SELECT DISTINCT query_id FROM pool)
  UNION ALL SELECT query_id, rank + 1, vec_id, list_append(ids, vec_id), list_append(chosen, v) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, r) AS nth FROM (
    SELECT p.query_id, p.vec_id, p.v, p.r, w.rank, w.ids, w.chosen, CASE WHEN p.n <= 8 THEN p.score ELSE round(0.6::DOUBLE * p.score - 0.4::DOUBLE * greatest(0, coalesce(list_max(list_transform(w.chosen, lambda c: list_dot_product(c, p.v))), 0)), 12) END AS value
    FROM walk w JOIN pool p USING (query_id) WHERE w.rank < 8 AND NOT list_contains(w.ids, p.vec_id))) WHERE nth = 1)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id FROM walk WHERE rank > 0""",
    "speaker_similarity": "WITH " + _COS.split(",\ncos")[0] + " SELECT * FROM (SELECT a.vec_id // 20 AS recording_id, a.vec_id AS a, b.vec_id AS b, round(" + _DOT.format("a.v", "b.v") + ", 4) AS cosine FROM nv a JOIN nv b ON a.vec_id // 20 = b.vec_id // 20 WHERE a.vec_id < b.vec_id) WHERE cosine >= 0.2",
}
