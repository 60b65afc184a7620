"""Functions by name in SQL give what the column functions give."""

from pyspark.sql import functions as F

from confab.functions import sql
from confab.functions import text as t

TEXTS = ["Zażółć  gęślą jaźń!", "", "ddzwoń rzeka szczotka czas chleb", "a", None, 'x {"a": {"b": 1}} y {', "Hannah-Banana 12"]


def test_equal_to_the_columns(spark):
    assert sql.register(spark) == sql.register(spark)
    df = spark.createDataFrame([(i, a, TEXTS[-i]) for i, a in enumerate(TEXTS)], "i int, a string, b string")
    want = df.select("i", t.folded(F.col("a")), t.tokens(F.col("a")), t.phonetic_key(F.col("a")), t.similarity(F.col("a"), F.col("b")), t.clock(F.col("i") * 61_000), t.first_json(F.col("a")))
    got = spark.sql("SELECT i, fold_text(a), word_tokens(a, 3), phonetic_key(a), edit_similarity(a, b), clock_text(i * 61000), first_object(a) FROM {df}", df=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_windows(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "")], "i int, a string")
    got = spark.sql("SELECT i, w.window_no, w.chunk FROM {df} d, LATERAL text_windows(d.a, 4, 1) w", df=df).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j"), (2, 0, "abc"), (3, 0, "")]
