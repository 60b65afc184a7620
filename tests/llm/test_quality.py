import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import quality
from confab.llm.common import table as read
from tests.llm.support import awkward, table

SF = "/root/testdata/sf0.1"


def test_scores_of_awkward_texts(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (12, 0), (13, 1), (None, 1), (6, None), (2, 7)], "doc_id long, quality int")
    docs = table(spark, [*awkward(), (None, "x", None)])
    rows = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(awkward()) + 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_without_labels_or_rows(spark):
    docs, none = table(spark, awkward()), spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}
    assert quality.scored(table(spark, []), model).collect() == []


def test_compiled_rules_equal_the_model():
    r = np.random.default_rng(3)
    x = r.random((600, len(quality.STATS)))
    y = ((x[:, 2] > 0.6) & (x[:, 4] <= 0.5)).astype(float)
    model = quality.fit(x, y)
    total = np.full(600, model.intercept)
    for w, rule in model.rules:
        total += w * np.all([x[:, i] > b if above else x[:, i] <= b for i, above, b in rule], axis=0)
    for w, i, low, high in model.linear:
        total += w * np.clip(x[:, i], low, high)
    assert ((total > 0) == (y == 1)).mean() > 0.97
    assert 0 < len(model.rules) < 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = quality.op3_quality(spark, SF).filter("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    area = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    right = ((got["score"] >= 0.5) == (got["quality"] == 1)).mean()
    print("auc", area, "accuracy", right)
    assert area > 0.95 and right > 0.95 and docs.count()


def test_compiled_column_equals_the_rules_row_by_row(spark):
    """The Spark column against the rules as stated, on statistics of whole texts worked out one by one."""
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    assert model.rules and quality.train(docs.repartition(5), labels) == model
    got = {r.doc_id: (r.score, r.predicted) for r in quality.scored(docs, model, keep=["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        x = quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        total = model.intercept
        for weight, rule in model.rules:
            if all(x[i] > bound if above else x[i] <= bound for i, above, bound in rule):
                total += weight
        for weight, i, low, high in model.linear:
            total += weight * min(max(x[i], low), high)
        score = 1 / (1 + np.exp(-total))
        assert got[r.doc_id] == (pytest.approx(score, abs=1e-9), int(score >= 0.5))
