"""Streams in random micro-batches, and after restarts, against the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from confab.sources.storage import scratch_path
from confab.streaming import sessions as st
from confab.streaming import stateful as live

KIND = "session long, seq long, kind string, item string, value string"


def events(seed, n=260):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["append", "append", "label", "label", "translate", "translate", "other", "reset"] if i % 9 == 0 else ["append", "label", "translate"])
        rows.append((r.randrange(6), i, kind, r.choice("abcd"), None if r.random() < 0.1 else f"v{i}"))
    return rows


def plain(rows):
    """The events in order, one after the other."""
    out = {}
    for session in {x[0] for x in rows}:
        items = {}
        for _, _, kind, item, value in sorted((x for x in rows if x[0] == session), key=lambda x: x[1]):
            if kind == "reset":
                items = {}
                continue
            if kind not in live.KINDS:
                continue
            own = items.setdefault(item, [{}, 0])
            own[1] += 1
            name, way = live.KINDS[kind]
            if way == -1 or name not in own[0]:
                own[0][name] = value
        out |= {(session, k): (*(v.get(c) for c in live.COLUMNS), n) for k, (v, n) in items.items()}
    return out


def table(df):
    return {(r.session, r.item): (r.text, r.text_pl, r.speaker, r.n_events) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_and_stream_equal_the_loop(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, KIND)
    want = plain(rows)
    assert table(live.item_states(df)) == want
    got = st.replayed(df.orderBy(F.rand(seed)), live.item_changes, "update", 5, ["session", "item"])
    assert table(got.filter("n_events > 0")) == want


def test_restart_goes_on_where_it_ended(spark):
    """Half the files, an end, the other half with the same progress, then a start with nothing new."""
    rows = events(3)
    random.Random(5).shuffle(rows)
    source, log, progress = (scratch_path(spark, n) for n in ("source", "log", "progress"))
    for part in (rows[:130], rows[130:], []):
        if part:
            spark.createDataFrame(part, KIND).repartition(3).write.mode("append").parquet(source)
        live.run_stream(source, spark.createDataFrame([], KIND).schema, live.item_changes, log, progress)
        done = rows[:130] if part == rows[:130] else rows
        got = live.merged_log(spark, log, spark.read.parquet(log).drop("batch").schema, ["session", "item"])
        assert table(got.filter("n_events > 0")) == plain(done)


def test_an_item_is_read_and_written_once():
    """Each call to the state is a message: one to read a touched item, one to write or remove it."""
    from pyspark.sql import Row

    calls, held = [], {}

    class Items(live.Items):
        def __init__(self):
            self.reset = type("Value", (), {"get": lambda s: None, "update": lambda s, v: calls.append("reset")})()
            self.items = type("Map", (), {"getValue": lambda s, k: calls.append("get") or held.get(k), "updateValue": lambda s, k, v: calls.append("put") or held.__setitem__(k, v), "removeKey": lambda s, k: calls.append("remove") or held.pop(k), "keys": lambda s: iter([*held])})()

    rows = [Row(seq=n, kind=k, item=i, value=f"{k}{n}") for n, k, i in ((3, "append", "a"), (1, "append", "a"), (2, "label", "b"))]
    out = list(Items().handleInputRows((7,), iter(rows), None))
    assert [(r.session, r.item, r.text, r.speaker, r.n_events) for r in out] == [(7, "a", "append1", None, 2), (7, "b", None, "label2", 1)]
    assert calls == ["get", "put"] * 2
    out = list(Items().handleInputRows((7,), iter([Row(seq=9, kind="reset", item=None, value=None)]), None))
    assert [r.n_events for r in out] == [0, 0] and calls[4:] == ["reset"] + ["get", "remove"] * 2 and not held
