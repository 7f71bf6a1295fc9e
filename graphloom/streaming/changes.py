"""File changes as a stream: debounce, filters, flushes into the store, recent changes."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.globs import excluded
from ..model import CHANGES
from ..store import GraphStore, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEBOUNCE_MS, RING = 500, 200
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_BURST = "started bigint, ended bigint, change_type string, events bigint"


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of change records (JSON lines) dropped into a folder; deletions are records too."""
    return spark.readStream.schema(CHANGES).json(path)


def relevant(changes: DataFrame, repos: DataFrame, globs=()) -> DataFrame:
    """Changes of known repositories outside the excluded paths; a stream-static join."""
    kept = changes.filter("file_path is not null")
    kept = kept.filter(~excluded(F.col("file_path"), globs)) if globs else kept
    return kept.join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")


def _last_kind(order: str) -> Column:
    """Of changes at one time that of the greatest name wins, so that none depends on how rows came."""
    return F.max_by("change_type", F.struct(order, "change_type")).alias("change_type")


def debounced(changes: DataFrame, quiet_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """(repo_id, file_path, started, ended, change_type, events): bursts of a path by the times of the changes, closed by ``quiet_ms`` of silence; the last kind wins.

    On a stream a burst comes out once a change ``late`` after its end has come. ``settled`` needs no later change.
    """
    by = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return by.groupBy(F.session_window("ts", f"{quiet_ms} milliseconds").alias("w"), "repo_id", "file_path").agg(_last_kind("ts"), F.count("*").alias("events")).select("repo_id", "file_path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "change_type", "events")


class Debounce(StatefulProcessor):
    """One burst and one timer a path: each change puts the timer off, and when it goes off the burst comes out."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.burst = handle, handle.getValueState("burst", _BURST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, ended, kind, events = self.burst.get() if self.burst.exists() else (None, None, None, 0)
        for r in rows:
            started = r.us if started is None else min(started, r.us)
            if ended is None or (r.us, r.change_type) >= (ended, kind):
                ended, kind = r.us, r.change_type
            events += 1
        self.burst.update((started, ended, kind, events))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            started, ended, kind, events = self.burst.get()
            self.burst.clear()
            yield Row(repo_id=key[0], file_path=key[1], started=started, ended=ended, change_type=kind, events=events)

    def close(self) -> None:
        pass


def settled(changes: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """A stream of (repo_id, file_path, started, ended, change_type, events): a path's burst comes out as soon as no change of it has come for ``quiet_ms``, by the clock of the stream, whether or not anything else changes.

    ``started`` and ``ended`` are the times of its first and last change; the last kind wins. State is one row and one timer a path that isn't quiet yet, in RocksDB: start the stream within ``timers``.
    """
    known = changes.select("repo_id", "file_path", F.coalesce("change_type", F.lit("MODIFIED")).alias("change_type"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"))
    out = known.groupBy("repo_id", "file_path").transformWithState(Debounce(quiet_ms), f"repo_id string, file_path string, {_BURST}", "Append", "ProcessingTime")
    return out.select("repo_id", "file_path", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "change_type", "events")


def timers(spark: SparkSession, start: Callable):
    """``start()`` with the state store that timers need; the session's own setting stays for other streams."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        return start()
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)


def deduplicated(changes: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Repeated records of one (repo, file, kind, time) once."""
    keys = ["repo_id", "file_path", "change_type", "ts"]
    return changes.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys) if changes.isStreaming else changes.dropDuplicates(keys)


def recent_changes(changes: DataFrame, limit: int = RING, repo_id: str | None = None) -> DataFrame:
    kept = changes if repo_id is None else changes.filter(F.col("repo_id") == repo_id)
    return kept.orderBy(F.desc("ts"), "repo_id", "file_path", "change_type").limit(min(limit, RING))


def flush(store: GraphStore, parse: Callable[[DataFrame], tuple[DataFrame, ...]], order: str = "ended") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: old rows of every changed file go; what ``parse`` makes of the modified ones (elements, edges, and if it likes rows of file_index) comes in. A file that doesn't parse leaves no rows. A batch without changes writes nothing."""

    def batch(changes: DataFrame, _: int) -> None:
        files = materialize(changes.groupBy("repo_id", "file_path").agg(_last_kind(order)))
        if not files.isEmpty():
            store.replace_files(files, *parse(files.filter("change_type <> 'DELETED'").select("repo_id", "file_path")))

    return batch


def watch(spark: SparkSession, log: str | DataFrame, store: GraphStore, repos: DataFrame, parse, checkpoint: str, globs=(), once: bool = True, quiet_ms: int = DEBOUNCE_MS):
    """The running query: change log (its folder, or a stream of changes) -> relevant -> settled -> store.

    A changed file is in the store once it has been quiet for ``quiet_ms``. ``once`` takes what is there and stops: as nothing more comes, nothing waits.
    """
    known = relevant(log if isinstance(log, DataFrame) else change_log(spark, log), repos, globs)
    if once:
        return known.writeStream.foreachBatch(flush(store, parse, "ts")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    out = settled(known, quiet_ms).writeStream.foreachBatch(flush(store, parse)).option("checkpointLocation", checkpoint).outputMode("append")
    return timers(spark, out.trigger(processingTime=f"{max(100, quiet_ms // 2)} milliseconds").start)


def wait_until_quiet(query, most_s: float = 300.0) -> None:
    """Until a running ``settled`` query has read all that is there and no path of it waits for its timer."""
    until, quiet = time.time() + most_s, 0
    while quiet < 2 and query.isActive and time.time() < until:
        seen = query.lastProgress
        if seen and seen["batchId"] > 0 and not seen["numInputRows"] and not any(s["customMetrics"].get("numRegisteredTimers") or s["numRowsTotal"] for s in seen["stateOperators"]):
            quiet += 1
        time.sleep(0.1)
    if query.exception():
        raise query.exception()
    if quiet < 2:
        raise TimeoutError(f"changes still wait after {most_s} s")


def stop_between(query, most_s: float = 30.0) -> None:
    """Stop a query while no batch of it runs, so that none is broken off; after ``most_s`` in any case."""
    until = time.time() + most_s
    while query.isActive and query.status["isTriggerActive"] and time.time() < until:
        time.sleep(0.02)
    query.stop()


def watched_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo_id").agg(F.count_distinct(F.regexp_replace("file_path", "/?[^/]*$", "")).alias("directories"), F.count("*").alias("events"))


def collected(stream: DataFrame, path: str, checkpoint: str, wait: bool = False) -> DataFrame:
    """All that a stream gives for what is there now, written under ``path`` batch by batch; a batch that is repeated replaces its own files. ``wait``: until timers have gone off."""

    def batch(rows: DataFrame, n: int) -> None:
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    if wait:
        query = timers(stream.sparkSession, out.trigger(processingTime="1 second").start)
        try:
            wait_until_quiet(query)
        finally:
            stop_between(query)
    else:
        timers(stream.sparkSession, out.trigger(availableNow=True).start).awaitTermination()  # state on disk: it may be as large as the log
    at = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration()).exists(at):  # there were no rows
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).option("basePath", path).parquet(f"{path}/batch=*")
