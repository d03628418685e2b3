"""Structured Streaming twins of the telemetry operators. Watermarks and windows are parameters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tessera.functions import color
from tessera.functions.text import file_name
from tessera.operators.telemetry import operation_aggregates, resource_bands
from tessera.operators.transfer import moment_transfer
from tessera.sources.images import explode_pixels, write_manifest

LATE = "10 minutes"


def running_operation_statistics(metrics: DataFrame, window: str = "1 minute", late: str = LATE) -> DataFrame:
    """Operation statistics by event-time window; also a batch operator, as windows mean the same there."""
    timed = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    out = timed.groupBy(F.window("ts", window), "operation").agg(*operation_aggregates())
    return out.select(F.col("window.start").alias("window_start"), "operation", *[c for c in out.columns if c not in ("window", "operation")])


HEALTH = "algorithm_id string, calls bigint, errors bigint, status string, changed boolean, last_errors array<bigint>"
STATE = "calls bigint, errors bigint, status string, last_errors array<bigint>"


def _health(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    calls, errors, status, last = state.get if state.exists else (0, 0, "", [])
    last = list(last)
    for f in frames:
        calls += len(f)
        bad = f.loc[~f["success"].astype(bool)].sort_values(["ts", "event_id"])
        errors += len(bad)
        last = (last + bad["event_id"].tolist())[-10:]
    rate = 1 - errors / calls
    now = "critical" if rate < 0.5 else "warning" if rate < 0.8 else "healthy"
    state.update((calls, errors, now, last))
    yield pd.DataFrame([(key[0], calls, errors, now, bool(now != status), last)], columns=["algorithm_id", "calls", "errors", "status", "changed", "last_errors"])


def running_algorithm_health(metrics: DataFrame) -> DataFrame:
    """A row for each algorithm of a micro-batch: its counts so far, whether its status changed, and its last ten errors; state of a bounded size."""
    return metrics.groupBy("algorithm_id").applyInPandasWithState(_health, HEALTH, STATE, "append", GroupStateTimeout.NoTimeout)


def threshold_alerts(samples: DataFrame) -> DataFrame:
    """Resource samples (ts, memory_percent, disk_percent, disk_free_gb, cpu_percent) with any band that is not healthy."""
    bands = resource_bands(F.col("memory_percent"), F.col("disk_percent"), F.col("disk_free_gb"), F.col("cpu_percent"))
    banded = samples.withColumn("bands", bands).select("ts", "bands.*")
    return banded.filter("memory <> 'healthy' OR disk <> 'healthy' OR cpu <> 'healthy'")


def request_spans(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = LATE, keep: Sequence[str] = ()) -> DataFrame:
    """Starts (request_id, ts) with their ends (request_id, ts) within a time bound; unmatched starts come once the watermark is past.

    Columns ``keep`` of both are kept, those of the end as end_<name>.
    """
    s = starts.select("request_id", F.col("ts").alias("start_ts"), *keep)
    e = ends.select(F.col("request_id").alias("end_request"), F.col("ts").alias("end_ts"), *[F.col(c).alias(f"end_{c}") for c in keep])
    if starts.isStreaming:
        s, e = s.withWatermark("start_ts", late), e.withWatermark("end_ts", late)
    same = (F.col("request_id") == F.col("end_request")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {within}"))
    return s.join(e, same, "left_outer").select("request_id", "start_ts", "end_ts", *keep, *[f"end_{c}" for c in keep])


SPANS = "request_id string, start_id bigint, start_us bigint, end_id bigint, end_us bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenRequests(StatefulProcessor):
    """The starts of a key that no end has closed yet; each goes with the next end, or alone when its time is over."""

    def __init__(self, within_us: int) -> None:
        self.within_us = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start_id bigint, start_us bigint")

    def _expiry(self, start_us: int) -> int:
        return (start_us + self.within_us) // 1000 + 1

    def _wait(self, waiting: list[tuple[int, int]], before: bool) -> None:
        """Keep these starts, instead of those before; the first whose time is over wakes the key, and then sees to the others."""
        if before and not waiting:
            self.open.clear()
        if waiting:
            self.open.put(waiting)
            self.handle.registerTimer(self._expiry(min(at for _, at in waiting)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = sorted(r for f in rows for r in zip(f["ts_us"].tolist(), f["event_id"].tolist(), f["starts"].tolist(), strict=True))
        # Starts of earlier batches, the first in time last, as they may be later than rows of this one.
        before = sorted((tuple(r) for r in self.open.get()), key=lambda s: s[1], reverse=True)
        held, live, waiting, out = bool(before), [], [], []
        for at, number, starts in new:
            while before and before[-1][1] <= at:
                live.append(before.pop())
            if starts:
                live.append((number, at))
                continue
            # Every start before this end is either closed or too old for it and for all later ones of this batch.
            for s in live:
                if at <= s[1] + self.within_us:
                    out.append((key[0], *s, number, at))
                else:
                    waiting.append(s)
            live = []
        self._wait(waiting + live + before, held)
        if out:
            yield _span_rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [tuple(r) for r in self.open.get()]
        self._wait([s for s in waiting if self._expiry(s[1]) > upto], bool(waiting))
        over = [(key[0], *s, None, None) for s in waiting if self._expiry(s[1]) <= upto]
        if over:
            yield _span_rows(over)

    def close(self) -> None:
        pass


def _span_rows(rows: list[tuple]) -> pd.DataFrame:
    request, start, start_us, end, end_us = zip(*rows, strict=True)
    # A column is all numbers or all nulls; frames of a key are small, and extension types would cost more than the rest.
    return pd.DataFrame({"request_id": request, "start_id": start, "start_us": start_us, "end_id": end, "end_us": end_us})


def next_end_spans(events: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each start of a stream (request_id, event_id, ts, starts) with the next end of its key within a time, by state and timers.

    A start waits in the state of its key until an end closes it, or until the watermark is past its time: then it comes
    without an end. So a key without open starts has no state, and one has no more of it than its starts of that time.
    Needs the RocksDB state store; the batch twin is :func:`tessera.operators.telemetry.request_spans`.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    within_us = int(pd.Timedelta(within) / pd.Timedelta("1us"))
    timed = events.withWatermark("ts", late).select("request_id", "event_id", "ts", "starts", F.unix_micros("ts").alias("ts_us"))
    return timed.groupBy("request_id").transformWithStateInPandas(OpenRequests(within_us), SPANS, "Append", "EventTime")


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there now and stop; ``each`` gets every micro-batch with its number."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def incremental_transfer(spark: SparkSession, folder: str, reference: DataFrame, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Moment transfer of images that are new in a folder since the last run: each once, by the file source's checkpoint.

    A micro-batch has at most ``files_per_batch`` files, which bounds the list of its paths. Results are pixel tables
    by image; a manifest beside them has one row for each file, with an error for those that don't decode. Both are
    written under the number of the batch, the manifest last: a batch that runs again replaces what it wrote, and one
    without a manifest counts for nothing (:func:`committed_pixels`).
    """
    new = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]
        if not paths:
            return
        session = batch.sparkSession
        raw = session.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
        found = raw.select(file_name(F.col("origin")).alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data")
        pixels = explode_pixels(found).select("image_id", "x", "y", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")).alias("lab")).select("image_id", "x", "y", "lab.*")
        began = time.monotonic()
        moment_transfer(pixels, reference).write.mode("overwrite").partitionBy("image_id").parquet(f"{out}/pixels/batch={number}")
        # Images of a micro-batch are worked on together, so each is given an equal part of its time.
        each_ms = (time.monotonic() - began) * 1000 / len(paths)
        ok = found.select("image_id", F.lit(True).alias("success"))
        manifest = batch.select(file_name(F.col("path")).alias("image_id")).join(ok, "image_id", "left")
        manifest = manifest.select("image_id", F.coalesce("success", F.lit(False)).alias("success"), F.when(F.col("success").isNull(), "UNREADABLE_IMAGE").alias("error"), F.when(F.col("success"), F.lit(each_ms)).alias("elapsed_ms"))
        write_manifest(manifest, f"{out}/manifest/batch={number}", "overwrite")

    return run_available(new, checkpoint, each)


def committed_pixels(spark: SparkSession, out: str) -> DataFrame:
    """The pixels of all batches of :func:`incremental_transfer` whose manifest was written."""
    batches = spark.read.parquet(f"{out}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{out}/pixels").join(F.broadcast(batches), "batch", "left_semi")
