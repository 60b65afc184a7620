"""The text functions by name in SQL: temporary functions whose bodies are SQL, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from confab.functions.text import DIGRAPHS, FOLD_FROM, FOLD_TO


def _key() -> str:
    key = "fold_text(word)"
    for a, b in DIGRAPHS:
        key = f"replace({key}, '{a}', '{b}')"
    return rf"regexp_replace(regexp_replace({key}, r'(.)\1+', '$1'), '[aeiou]', '')"


#: Signature, result and body of each; one may use those before it.
FUNCTIONS = (
    ("fold_text(text STRING)", "STRING", f"trim(regexp_replace(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[^a-z0-9]+', ' '))"),
    ("word_tokens(text STRING, least INT)", "ARRAY<STRING>", "filter(split(fold_text(text), ' '), t -> length(t) >= least)"),
    ("phonetic_key(word STRING)", "STRING", _key()),
    ("edit_similarity(a STRING, b STRING)", "DOUBLE", "1 - levenshtein(a, b) / greatest(length(a), length(b))"),
    ("clock_text(ms BIGINT)", "STRING", "format_string('%d:%02d', floor(floor(ms / 1000) / 60), floor(ms / 1000) % 60)"),
    ("first_object(text STRING)", "STRING", r"nullif(regexp_extract(text, r'(?s)\{.*\}', 0), '')"),
)
#: Table functions: char_windows('...', width, overlap) gives a row for each window.
TABLES = (
    (
        "text_windows(text STRING, width INT, overlap INT)",
        "TABLE (window_no INT, chunk STRING)",
        "SELECT w.pos, substring(text, w.at + 1, width) FROM (SELECT posexplode(CASE WHEN length(text) <= width THEN array(0) ELSE sequence(0, length(text) - 1, width - overlap) END) AS (pos, at)) w",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session, anew where they are there; their names."""
    for signature, kind, body in FUNCTIONS + TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in FUNCTIONS + TABLES]
