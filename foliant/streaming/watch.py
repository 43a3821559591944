"""File changes as a stream: relevance filter, debounce, and incremental syncs once a burst has ended."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliant.functions.paths import basename, excluded, under
from foliant.scale import ship
from foliant.sources.scan import Source, SourceList
from foliant.streaming.changes import changes

#: Names of temporary files.
TEMP_PREFIXES = ("~$",)
TEMP_SUFFIXES = (".tmp", ".swp", ".part")
QUIET_MS = 1500
#: Partitions of the bursts' state: one key a source.
STATE_PARTITIONS = 4
BURST = "source string, started long, ended long, n_events long"


def relevant(path: Column, sources: list[Source]) -> Column:
    """No temporary file, below an enabled source, and excluded by none of their rules."""
    name = basename(path)
    temp = reduce(lambda a, b: a | b, [name.startswith(p) for p in TEMP_PREFIXES] + [F.lower(name).endswith(s) for s in TEMP_SUFFIXES])
    live = [s for s in sources if s.enabled]
    inside = reduce(lambda a, b: a | b, [under(path, F.lit(s.path)) for s in live], F.lit(False))
    out = reduce(lambda a, b: a | b, [excluded(path, s.path, s.exclude_rules) for s in live], F.lit(False))
    return ~temp & inside & ~out


def debounce(events: DataFrame, keys: list[str] = (), quiet_ms: int = QUIET_MS, lateness: str = "10 minutes", time: str = "ts") -> DataFrame:
    """One row (keys, started, ended, n_events) per burst: events closer than the quiet gap belong together.

    On a stream the watermark closes a burst once its gap has passed; state holds open bursts only.
    """
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark(time, lateness)
    w = F.session_window(time, f"{quiet_ms} milliseconds")
    g = t.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("ended"))
    return g.select(*keys, F.col("w.start").alias("started"), "ended", "n_events")


class Quiet(StatefulProcessor):
    """Emits a source's burst when no event has come for the quiet time, by the clock. The burst and its timer are Spark's state.

    Events are (source, microseconds)."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "started long, ended long, n_events long, due long")

    def handleInputRows(self, key, rows, timerValues):
        times = [r.us for r in rows]
        now = timerValues.getCurrentProcessingTimeInMs()
        began, ended, n = min(times), max(times), len(times)
        if self.burst.exists():
            old = self.burst.get()
            began, ended, n = min(began, old[0]), max(ended, old[1]), n + old[2]
            self.handle.deleteTimer(old[3])
        due = now + self.quiet_ms
        self.burst.update((began, ended, n, due))
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.burst.exists():
            began, ended, n, _ = self.burst.get()
            self.burst.clear()
            yield Row(source=key[0], started=began, ended=ended, n_events=n)

    def close(self) -> None:
        pass


def ended_bursts(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Streaming (source, started, ended, n_events) from streaming (source, ts): a burst that spans batches, or a restart, is one row, after its end.

    Unlike ``debounce`` it goes by the clock, so that the last burst ends though no later event moves a watermark on. The query
    needs the RocksDB state store; see ``Watcher.start``.
    """
    ship(events.sparkSession)
    t = events.select("source", F.unix_micros("ts").alias("us")).where("us is not null")
    out = t.groupBy("source").transformWithState(Quiet(quiet_ms), BURST, "append", "processingTime")
    return out.select("source", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n_events")


class Watcher:
    """Calls ``sync`` once a burst: when no relevant change has come for ``quiet_ms``. Syncs never overlap.

    Listings, bursts and timers are in the checkpoint: a program that dies in a burst's quiet time, or in a sync, makes up for it
    once it is started again. A failed sync is tried again after the quiet time, doubled each time, up to ``retries`` times; then
    the stream ends with the error and the burst stays in the checkpoint, for the next ``start``. Changes that come during a sync
    start a burst of their own. Sources that are added or taken away need a checkpoint of their own.
    """

    def __init__(self, spark: SparkSession, sources: SourceList, sync: Callable[[SourceList], dict], checkpoint: str, quiet_ms: int = QUIET_MS, retries: int = 3, poll_ms: int = 500):
        self.spark, self.sources, self.sync, self.checkpoint = spark, sources, sync, checkpoint.rstrip("/")
        self.quiet_ms, self.retries, self.poll_ms = quiet_ms, retries, poll_ms
        self.query: StreamingQuery | None = None
        self.results: list[dict] = []
        self.errors: list[str] = []
        self.bursts: list[tuple[str, datetime, datetime, int]] = []
        self._stopped = threading.Event()

    def _events(self) -> DataFrame:
        each = [changes(self.spark, s.path, f"{self.checkpoint}/listings-{i}").select(F.lit(s.path).alias("source"), "path", "ts") for i, s in enumerate(self.sources.enabled())]
        return reduce(DataFrame.unionByName, each).where(relevant(F.col("path"), self.sources.items))

    def _batch(self, ended: DataFrame, _: int) -> None:
        rows = ended.collect()  # a row a source at most; and all of the state's partitions must run
        if not rows:
            return
        for failures in range(self.retries + 1):
            try:
                self.results.append(self.sync(self.sources))
                self.bursts += [tuple(r) for r in rows]
                return
            except Exception as e:  # the watcher outlives a failed sync
                self.errors.append(f"{type(e).__name__}: {e}")
                last = e
            if failures < self.retries and self._stopped.wait(self.quiet_ms / 1000 * 2 ** (failures + 1)):
                break
        raise last

    def start(self) -> bool:
        """False if no source is enabled, or the watcher runs already."""
        if self.active() or not self.sources.enabled():
            return False
        self._stopped.clear()
        own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(STATE_PARTITIONS)}
        before = {k: self.spark.conf.get(k) for k in own}
        for k, v in own.items():
            self.spark.conf.set(k, v)
        try:  # a query keeps the settings that it was started with
            out = ended_bursts(self._events(), self.quiet_ms).writeStream.foreachBatch(self._batch).outputMode("append")
            self.query = out.option("checkpointLocation", f"{self.checkpoint}/query").trigger(processingTime=f"{self.poll_ms} milliseconds").start()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return True

    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        """End the stream. What is pending stays in the checkpoint, and so does a burst whose sync keeps failing."""
        self._stopped.set()
        if self.query is not None:
            self.query.stop()
