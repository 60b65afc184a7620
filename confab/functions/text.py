"""Text expressions: folding, tokens, repetition tests, phonetic keys and match scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded to ASCII: fixed values.
FOLD_FROM, FOLD_TO = "ąćęłńóśźż", "acelnoszz"
#: Digraphs replaced in this order, the last one twice (after ddz it appears anew): fixed values.
DIGRAPHS = (("rz", "z"), ("ch", "h"), ("sz", "s"), ("cz", "c"), ("dz", "z"), ("dz", "z"))


def folded(text: Column) -> Column:
    """Lower case, Polish letters folded, everything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), "[^a-z0-9]+", " "))


def tokens(text: Column, least: int = 3) -> Column:
    return F.filter(F.split(folded(text), " "), lambda t: F.length(t) >= least)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once: what a lambda refers to by its expression is made anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(text: Column) -> Column:
    """Distinct neighbours of the lower-cased words; none for fewer than two words."""
    last = lambda w: F.size(w) - 1
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), last(w)), F.slice(w, F.lit(2), last(w)), lambda a, b: F.concat_ws(" ", a, b)))
    return _bound(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(F.array().cast("array<string>")))


def is_repetition(a: Column, b: Column, least: float = 0.85) -> Column:
    """Word-bigram Jaccard of at least ``least``; without bigrams the trimmed lower-case texts are equal."""
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) >= least * F.size(F.array_union(x, y))
    either = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.trim(F.lower(a)) == F.trim(F.lower(b))).otherwise(jaccard(x, y))
    return _bound(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), lambda p: either(p["x"], p["y"]))


def is_word_run(text: Column, least: int = 5) -> Column:
    """One word at least ``least`` times and more than 70 % of all: such a word is in the middle of the sorted ones."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")), r"\s+"), lambda w: w != "")
    top = lambda ws, middle: F.size(F.filter(ws, lambda x: x == middle))
    run = lambda n, k: (n >= least) & (k >= least) & (k * 10 > n * 7)
    counted = lambda ws: _bound(F.get(F.array_sort(ws), (F.size(ws) / 2).cast("int")), lambda m: F.struct(F.size(ws).alias("n"), top(ws, m).alias("k")))
    return _bound(_bound(words, counted), lambda c: run(c["n"], c["k"]))


def phonetic_key(word: Column) -> Column:
    """Digraphs reduced, repeats collapsed, vowels dropped."""
    key = folded(word)
    for a, b in DIGRAPHS:
        key = F.replace(key, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(key, r"(.)\1+", "$1"), "[aeiou]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def keyword_similarity(query: Column, word: Column) -> Column:
    """1 for equal words or a prefix either way; else the edit similarity within two edits; counts above 0.6."""
    near = (F.length(query) >= 4) & (F.length(word) >= 3) & (F.levenshtein(query, word) <= 2)
    sim = F.when(word.startswith(query) | query.startswith(word), F.lit(1.0)).when(near, similarity(query, word)).otherwise(0.0)
    return F.when(sim > 0.6, sim).otherwise(0.0)


def first_json(text: Column, greedy: bool = True) -> Column:
    """First {...}: up to the last brace, or the first without nested braces."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}" if greedy else r"(?s)\{[^{}]*\}", 0), F.lit(""))


def clock(ms: Column) -> Column:
    """m:ss; minutes may exceed 59."""
    sec = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(sec / 60), sec % 60)


def seconds_of(stamp: Column) -> Column:
    """H:M:S, M:S or seconds as a number; anything else, empty or N/A is 0."""
    parts = F.transform(F.split(F.trim(stamp), ":"), lambda p: F.expr("1") * p.try_cast("double"))
    n = F.size(parts)
    value = F.when(n == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(0)) * 60 + F.get(parts, F.lit(1))).when(n == 1, F.get(parts, F.lit(0)))
    return F.coalesce(value, F.lit(0.0))
