"""DuckDB oracles of the order-dependent folds: recursive queries that walk each recording row by row."""

from __future__ import annotations

from confab.plans.segment_queries import _ASSIGN, _OVER, _sql, _talk

_END = "rtrim({0}) SIMILAR TO '(?s).*[.!?…;]'"
_KEPT = "(SELECT recording_id, -1 AS seg_id, {state} FROM (SELECT DISTINCT recording_id FROM segments))"


def walk(name: str, state: str, step: str, rows: str = "segments") -> str:
    """A recursive table ``name``: ``state`` before the first row of each recording, ``step`` from w (state) and f (next row)."""
    return f"""{name} AS (
  SELECT recording_id, CAST(-1 AS INT) AS seg_id, {state} FROM (SELECT DISTINCT recording_id FROM {rows})
  UNION ALL {step.replace("FROM_", f"FROM {name} w JOIN {rows} f ON f.recording_id = w.recording_id AND f.seg_id = w.seg_id + 1")})"""


def recursive(body: str, *ctes: str) -> str:
    return _sql(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _votes(name: str, source: str, reach: int, below: int, other: bool) -> tuple[str, str]:
    """Rows with what is to their right, and the vote over them."""
    right = ", ".join(f"lead(speaker, {i}) OVER o" for i in range(1, reach + 1))
    rows = f"{name}_rows AS (SELECT recording_id, seg_id, speaker, start_ms, end_ms, list_filter([{right}], lambda x: x IS NOT NULL) AS after_ FROM {source} WINDOW o AS (PARTITION BY recording_id ORDER BY seg_id))"
    differs = "winner <> speaker" if other else "true"
    step = f"""SELECT recording_id, seg_id, label, list_append(tail, label)[-{reach}:] FROM (
    SELECT *, CASE WHEN end_ms - start_ms < {below} AND len(near) > 0 AND n >= greatest(2, len(near) // 2) AND {differs} THEN winner ELSE speaker END AS label FROM (
      SELECT *, list_max(counts) AS n, near[list_position(counts, list_max(counts))] AS winner FROM (
        SELECT *, list_transform(near, lambda x: len(list_filter(near, lambda y: y = x))) AS counts FROM (
          SELECT f.*, w.tail, list_concat(w.tail, f.after_) AS near FROM_))))"""
    return rows, walk(name, "CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS tail", step, f"{name}_rows")


def _bridge(name: str, source: str) -> tuple[str, str]:
    rows = f"{name}_rows AS (SELECT recording_id, seg_id, speaker, start_ms - lag(end_ms) OVER o < 500 AND lead(start_ms) OVER o - end_ms < 500 AS near, lead(speaker) OVER o AS next_ FROM {source} WINDOW o AS (PARTITION BY recording_id ORDER BY seg_id))"
    step = "SELECT f.recording_id, f.seg_id, CASE WHEN w.seg_id >= 0 AND f.near AND w.label = f.next_ AND w.label <> f.speaker THEN w.label ELSE f.speaker END FROM_"
    return rows, walk(name, "CAST(NULL AS VARCHAR) AS label", step, f"{name}_rows")


_CHANGED = "SELECT s.recording_id, s.seg_id, label AS speaker, label <> s.speaker AS changed FROM {0} v JOIN segments s USING (recording_id, seg_id)"


def _fragments(gap: int, most: int, same: bool) -> str:
    who = "f.speaker = w.speaker" if same else "true"
    step = f"""SELECT recording_id, seg_id, CASE WHEN j THEN first_id ELSE seg_id END, CASE WHEN j THEN s0 ELSE own_speaker END, CASE WHEN j THEN start0 ELSE start_ms END, end_ms, CASE WHEN j THEN rtrim(text0) || ' ' || ltrim(text) ELSE text END FROM (
    SELECT f.*, f.speaker AS own_speaker, w.first_id, w.speaker AS s0, w.start_ms AS start0, w.text AS text0, coalesce(w.seg_id >= 0 AND {who} AND f.start_ms - w.end_ms <= {gap} AND f.end_ms - w.start_ms <= {most} AND NOT {_END.format('w.text')}, false) AS j FROM_)"""
    state = "CAST(-1 AS INT) AS first_id, CAST('' AS VARCHAR) AS speaker, CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms, CAST('' AS VARCHAR) AS text"
    return recursive("SELECT recording_id, first_id, arg_max(speaker, seg_id) AS speaker, arg_max(start_ms, seg_id) AS start_ms, arg_max(end_ms, seg_id) AS end_ms, arg_max(text, seg_id) AS text FROM v WHERE seg_id >= 0 GROUP BY ALL", walk("v", state, step))


_READ = r"""read_ AS (SELECT *, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS b,
  len(ws) >= 5 AND top >= 5 AND top * 10 > len(ws) * 7 AS run_ FROM (SELECT *, coalesce(list_max(list_transform(list_distinct(ws), lambda y: len(list_filter(ws, lambda z: z = y)))), 0) AS top
  FROM (SELECT *, regexp_split_to_array(trim(lower(text)), '\s+') AS l, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+'), lambda y: y <> '') AS ws FROM segments)))"""
_SAME = "CASE WHEN len(b) = 0 OR len(pb) = 0 THEN trim(lower(text)) = trim(lower(prev)) ELSE len(list_intersect(b, pb)) >= 0.85 * len(list_distinct(list_concat(b, pb))) END"
_REPEATS = walk(
    "v",
    "CAST(NULL AS VARCHAR) AS prev, CAST([] AS VARCHAR[]) AS pb, false AS kept",
    f"""SELECT recording_id, seg_id, CASE WHEN seen AND (again OR NOT run_) THEN text ELSE prev END, CASE WHEN seen AND (again OR NOT run_) THEN b ELSE pb END, seen AND NOT again AND NOT run_ FROM (
    SELECT *, trim(text) <> '' AND start_ms >= 2000 AS seen, prev IS NOT NULL AND coalesce({_SAME}, false) AS again FROM (SELECT f.*, w.prev, w.pb FROM_))""",
    "read_",
)
_NEAR = walk(
    "v",
    "CAST(NULL AS VARCHAR) AS who, CAST([] AS VARCHAR[]) AS said, false AS kept",
    r"""SELECT recording_id, seg_id, CASE WHEN like_ THEN who ELSE speaker END, CASE WHEN like_ THEN said ELSE own END, NOT like_ FROM (
    SELECT *, coalesce(who = speaker AND CASE WHEN len(list_distinct(list_concat(own, said))) = 0 THEN true ELSE len(list_intersect(own, said)) > 0.85 * len(list_distinct(list_concat(own, said))) END, false) AS like_
    FROM (SELECT f.*, list_distinct(list_filter(regexp_split_to_array(trim(lower(f.text)), '\s+'), lambda y: y <> '')) AS own, w.who, w.said FROM_))""",
)
_BUFFER = walk(
    "v",
    "CAST('' AS VARCHAR) AS buf, CAST([] AS INT[]) AS ids, CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms, CAST('' AS VARCHAR) AS speaker, CAST(0 AS INT) AS n, CAST(NULL AS VARCHAR) AS out_, CAST([] AS INT[]) AS out_ids, CAST(0 AS BIGINT) AS out_start",
    """SELECT recording_id, seg_id, CASE WHEN full_ THEN right(t, 150) ELSE t END, CASE WHEN full_ THEN i[-3:] ELSE i END, CASE WHEN full_ THEN end1 ELSE s END, end1, sp, n + CASE WHEN full_ THEN 1 ELSE 0 END, CASE WHEN full_ THEN trim(t) END, i, s FROM (
    SELECT *, length(t) >= 800 AS full_ FROM (SELECT f.recording_id, f.seg_id, f.end_ms AS end1, w.n, CASE WHEN w.buf = '' THEN f.text ELSE w.buf || ' ' || f.text END AS t, list_append(w.ids, f.seg_id) AS i, CASE WHEN w.buf = '' THEN f.start_ms ELSE w.start_ms END AS s, CASE WHEN w.buf = '' THEN f.speaker ELSE w.speaker END AS sp FROM_))""",
)
_VOTE = _votes("v", "segments", 3, 1000, False)
_WIDE = _votes("v", "segments", 4, 1500, True)
_PAIRS = """pairs_ AS (SELECT recording_id, a, b, removed, kept, cosine, min(cosine) OVER (PARTITION BY recording_id) AS low FROM (SELECT x.recording_id, x.speaker AS a, y.speaker AS b, CASE WHEN length(x.speaker) >= length(y.speaker) THEN y.speaker ELSE x.speaker END AS removed, CASE WHEN length(x.speaker) >= length(y.speaker) THEN x.speaker ELSE y.speaker END AS kept,
    round(0.985::DOUBLE + ((x.recording_id * 7 + length(x.speaker) * 3 + length(y.speaker)) % 13) / 1000.0::DOUBLE, 4) AS cosine FROM (SELECT DISTINCT recording_id, speaker FROM segments) x JOIN (SELECT DISTINCT recording_id, speaker FROM segments) y ON x.recording_id = y.recording_id AND x.speaker < y.speaker)),
merges AS (SELECT recording_id, removed, arg_max(kept, a || '|' || b) AS kept FROM pairs_ WHERE low <= 0.99 AND cosine >= 0.99 AND recording_id % 11 <> 0 GROUP BY ALL),
merged AS (SELECT s.* EXCLUDE (speaker), coalesce(c.kept, b.kept, a.kept, s.speaker) AS speaker FROM segments s LEFT JOIN merges a ON a.recording_id = s.recording_id AND a.removed = s.speaker LEFT JOIN merges b ON b.recording_id = s.recording_id AND b.removed = a.kept LEFT JOIN merges c ON c.recording_id = s.recording_id AND c.removed = b.kept)"""

ORACLES = {
    "neighbour_vote": recursive(_CHANGED.format("v"), *_VOTE),
    "refined_vote": recursive(_CHANGED.format("v"), *_WIDE),
    "speaker_bridges": recursive(_CHANGED.format("v"), *_bridge("v", "segments")),
    "refine_pipeline": recursive(
        "SELECT recording_id, seg_id, label AS speaker FROM b WHERE seg_id >= 0",
        *_WIDE,
        "voted AS (SELECT s.* EXCLUDE (speaker), label AS speaker FROM segments s JOIN v USING (recording_id, seg_id))",
        *_bridge("b", "voted"),
    ),
    "sentence_fragments": _fragments(100, 15_000, True),
    "loose_fragments": _fragments(400, 20_000, False),
    "repetition_filter": recursive("SELECT recording_id, seg_id FROM v WHERE kept", _READ, _REPEATS),
    "near_dup_fold": recursive("SELECT recording_id, seg_id FROM v WHERE kept", _NEAR),
    "buffered_chunks": recursive(
        """SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seg_id, tail_) - 1 AS INT) AS chunk_id, text, array_to_string(ids, ',') AS segment_ids, start_ms, end_ms, speaker FROM (
  SELECT recording_id, seg_id, 0 AS tail_, out_ AS text, out_ids AS ids, out_start AS start_ms, end_ms, speaker FROM v WHERE out_ IS NOT NULL AND n <= 300
  UNION ALL SELECT recording_id, seg_id, 1, trim(buf), ids, start_ms, end_ms, speaker FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_id DESC) AS r FROM v) WHERE r = 1 AND n < 300 AND trim(buf) <> '')""",
        _BUFFER,
    ),
    "diarize_pipeline": recursive(
        "SELECT recording_id, seg_id, t.label AS speaker FROM labelled l JOIN (" + _talk("labelled", "speaker", "seg_id") + ") t USING (recording_id, speaker)",
        _OVER,
        _ASSIGN,
        "carried_ AS (SELECT s.* EXCLUDE (speaker), carried AS speaker FROM segments s JOIN assign_ a USING (recording_id, seg_id))",
        *_votes("v", "carried_", 3, 1000, False),
        "labelled AS (SELECT s.* EXCLUDE (speaker), label AS speaker FROM segments s JOIN v USING (recording_id, seg_id) WHERE trim(text) <> '')",
    ),
    "merged_speakers": _sql("SELECT recording_id, seg_id, t.label AS speaker FROM merged m JOIN (" + _talk("merged", "speaker", "seg_id") + ") t USING (recording_id, speaker)", _PAIRS),
}
