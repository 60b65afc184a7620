"""Live sessions as keyed state: append, translate, label and replace events in any micro-batches, merged into a table.

Every value in the state carries the number of the event that it came from. First-wins and last-wins then follow from the
numbers, not from arrival: events may come late, in any batches, again after a restart, and the state is that of
the whole stream in order. Changed rows go to a log in the shared folder, a folder for each batch that a repeated
batch overwrites; the table is the last row of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What each kind of event sets, and whether its first (1) or its last (-1) event stands.
KINDS = {"append": ("text", 1), "translate": ("text_pl", 1), "label": ("speaker", -1)}
COLUMNS = ("text", "text_pl", "speaker")


def item_states(events: DataFrame) -> DataFrame:
    """(session, item, text, text_pl, speaker, n_events) of ``events`` (session, seq, kind, item, value) in batch.

    Text and translation come from an item's first append and translate event, the speaker from its last label. A
    ``reset`` of a session has no item: what events before the last one set is gone. Equal ``seq`` of a session are one event's parts.
    """
    since = F.coalesce(F.max(F.when(F.col("kind") == "reset", F.col("seq"))).over(Window.partitionBy("session")), F.lit(-1))
    rows = events.withColumn("_since", since).filter((F.col("seq") > F.col("_since")) & F.col("kind").isin(*KINDS))
    best = {1: F.min_by, -1: F.max_by}
    values = [best[way](F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("seq"))).alias(name) for kind, (name, way) in KINDS.items()]
    return rows.groupBy("session", "item").agg(*values, F.count(F.lit(1)).alias("n_events"))


class Items(StatefulProcessor):
    """State of a session: its items' events that still count, and its last reset.

    For first-wins values a later reset may uncover a later event, so an item keeps its events until a reset
    passes them; a last-wins value keeps one. Rows come and go as rows, since a session has few in a batch, and each call to the state is
    a message: an item costs one to read it and one to write it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "seqs array<long>, kinds array<string>, vals array<string>")
        self.reset = handle.getValueState("reset", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.reset.get()
        since = last = held[0] if held else -1
        new: dict[str, list] = {}
        for r in rows:
            if r.kind == "reset":
                last = max(last, r.seq)
            elif r.kind in KINDS and r.seq > since:
                new.setdefault(r.item, []).append((r.seq, r.kind, r.value))
        touched = set(new)
        if last > since:
            self.reset.update((last,))
            touched |= {k[0] for k in self.items.keys()}
        for item in sorted(touched):
            held = self.items.getValue((item,))
            events = sorted({*(zip(*held, strict=True) if held else ()), *new.get(item, [])}, key=lambda e: e[:2])
            events = [e for e in events if e[0] > last]
            row = [next((v for s, k, v in events[::way] if k == kind), None) for kind, (_, way) in KINDS.items()]
            if events:
                self.items.updateValue((item,), tuple(list(c) for c in zip(*events, strict=True)))
            elif held:
                self.items.removeKey((item,))
            yield Row(session=key[0], item=item, **dict(zip(COLUMNS, row, strict=True)), n_events=len(events))

    def close(self) -> None:
        pass


def item_changes(events: DataFrame) -> DataFrame:
    """``item_states`` of a stream, in update mode: a row for each item that a batch changed; n_events is 0 where a reset took all."""
    kinds = f"session {dict(events.dtypes)['session']}, item string, {', '.join(f'{c} string' for c in COLUMNS)}, n_events long"
    return events.groupBy("session").transformWithState(Items(), kinds, "Update", "None")


def merged_log(spark: SparkSession, path: str, schema, key: list[str] | None) -> DataFrame:
    """What a log of batches holds: the last row of each ``key``, or, without key, the last batch as a whole."""
    log = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
    if key is None:
        return log.filter(F.col("batch") == log.agg(F.max("batch")).first()[0]).drop("batch")
    own = [c for c in log.columns if c not in (*key, "batch")]
    return log.groupBy(*key).agg(F.max_by(F.struct(*own), "batch").alias("_s")).select(*key, "_s.*")


def run_stream(source: str, schema, transform: Callable[[DataFrame], DataFrame], log: str, progress: str, mode: str = "update", files: int = 2) -> None:
    """Runs ``transform`` over what is new in the folder ``source``, ``files`` files a batch, into ``log``; goes on where ``progress`` ended.

    A batch's rows are written to its own folder, which replaces that of an attempt that was lost.
    """
    spark = SparkSession.active()
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{log}/batch={n}")
        query = transform(stream).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
