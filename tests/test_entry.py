import importlib
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

import __spark_entry__ as driver

ROOT = os.path.dirname(os.path.abspath(driver.__file__))


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(driver.SMOKE_DIR), reason="needs the test tables")
def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["recording_id", "speaker", "talk_ms", "share", "rank", "label"] and got.count() > 0


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert e.queries() and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_package_is_shipped_where_workers_cannot_import_it(spark, tmp_path, monkeypatch):
    cluster = importlib.import_module("confab.sources.cluster")
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append, raising=False)
    monkeypatch.setattr(cluster, "_SHIPPED", set())
    monkeypatch.setenv("PYTHONPATH", ROOT)
    cluster.ship(spark)
    assert sent == []
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    cluster.ship(spark)
    cluster.ship(spark)
    assert len(sent) == 1 and sent[0].endswith(".zip")


def test_shared_folder(spark):
    storage = importlib.import_module("confab.sources.storage")
    table = storage.written(spark.range(3), "t")
    path = table.inputFiles()[0]
    assert table.count() == 3 and spark.sparkContext.applicationId in path
    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(elsewhere)
    storage.cleared(spark)
    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))


def test_tables_on_the_way_to_a_settled_one_are_deleted(spark):
    storage = importlib.import_module("confab.sources.storage")
    seen = []

    def noted(df, label):
        out = storage.written(df, label)
        seen.extend(f.removeprefix("file://") for f in out.inputFiles())
        return out

    inner = lambda: noted(noted(spark.range(5), "a").filter("id > 1"), "b")
    outer = storage.settled(lambda: storage.settled(inner, "inner").filter("id > 2"), "outer")
    assert sorted(r.id for r in outer.collect()) == [3, 4]
    folder = os.path.dirname(os.path.dirname(outer.inputFiles()[0].removeprefix("file://")))
    assert seen and not any(map(os.path.exists, seen))
    assert not [n for n in os.listdir(folder) if n.startswith("inner-")]
    with pytest.raises(ValueError):
        storage.settled(lambda: noted(spark.range(2), "lost") and int("x"), "never")
    assert not any(map(os.path.exists, seen))
