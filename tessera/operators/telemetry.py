"""Operational telemetry: statistics of operations, health, spans and expectations over metric and log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scans import carried, in_ranges, inside

#: Health, worst last.
STATUSES = ("healthy", "warning", "critical")


def success_band(rate: Column) -> Column:
    return F.when(rate < 0.5, "critical").when(rate < 0.8, "warning").otherwise("healthy")


def resource_bands(memory_percent: Column, disk_percent: Column, disk_free_gb: Column, cpu_percent: Column) -> Column:
    """struct<memory,disk,cpu> of statuses by thresholds."""
    return F.struct(
        F.when(memory_percent > 90, "critical").when(memory_percent > 75, "warning").otherwise("healthy").alias("memory"),
        F.when((disk_percent > 95) | (disk_free_gb < 1), "critical").when((disk_percent > 85) | (disk_free_gb < 5), "warning").otherwise("healthy").alias("disk"),
        F.when(cpu_percent > 80, "warning").otherwise("healthy").alias("cpu"),
    )


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1, F.lit(-1))


def operation_aggregates() -> list[Column]:
    return [
        F.count("*").alias("calls"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.avg("memory_mb").alias("avg_memory_mb"), F.avg("cpu_percent").alias("avg_cpu_percent"), F.max("ts").alias("last_call"), F.count_if(~F.col("success")).alias("errors"),
    ]


def operation_statistics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("operation").agg(*operation_aggregates())


def algorithm_health(metrics: DataFrame) -> DataFrame:
    rate = F.avg(F.col("success").cast("double"))
    return metrics.groupBy("algorithm_id").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), rate.alias("success_rate")).withColumn("status", success_band(F.col("success_rate")))


def latest_per(df: DataFrame, keys: Sequence[str], n: int = 1, order: Sequence[Column] | None = None) -> DataFrame:
    """The n newest rows of each key; the window's limit is applied before the shuffle, so a hot key costs n rows a task."""
    by = order or (F.desc("ts"), F.desc("event_id"))
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("nth") <= n)


def latest(df: DataFrame, n: int, order: Sequence[Column] | None = None) -> DataFrame:
    """The n newest rows overall: a sort with a limit, no window."""
    return df.orderBy(*(order or (F.desc("ts"), F.desc("event_id")))).limit(n)


def chosen(df: DataFrame, operations: Sequence[str] = (), levels: Sequence[str] = ()) -> DataFrame:
    """Rows of some operations or levels; without any, all."""
    for column, values in (("operation", operations), ("level", levels)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def log_tail(logs: DataFrame, n: int, levels: Sequence[str] = ()) -> DataFrame:
    """The last n lines of a log (timestamp, level, message), oldest first; ties by message."""
    last = chosen(logs, levels=levels).orderBy(F.desc("timestamp"), F.desc("message")).limit(n)
    return last.orderBy("timestamp", "message")


def health_rollup(checks: DataFrame) -> DataFrame:
    """Counts by status, the worst status and the failing checks, over the latest result of each check (check, status, ts, event_id)."""
    now = latest_per(checks, ["check"])
    failing = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check")))), ",")
    worst = F.element_at(F.array(*map(F.lit, STATUSES)), (F.max(severity(F.col("status"))) + 1).cast("int"))
    return now.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], worst.alias("worst"), failing("warning").alias("warnings"), failing("critical").alias("criticals"))


def dashboard(metrics: DataFrame, n: int = 50) -> DataFrame:
    """Means over the newest n metrics beside counts over all."""
    recent = latest(metrics, n).agg(F.avg("duration_ms").alias("recent_avg_ms"), F.avg("memory_mb").alias("recent_avg_memory_mb"), F.count("*").alias("n_recent"))
    overall = metrics.agg(F.countDistinct("operation").alias("operations"), F.count("*").alias("calls"))
    return recent.join(F.broadcast(overall))


def request_metrics(requests: DataFrame) -> DataFrame:
    """Totals, success rate and times of successes (0 without requests)."""
    ok = F.col("success")
    return requests.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"),
        F.avg(F.when(ok, F.col("duration_ms"))).alias("avg_ms"), F.min(F.when(ok, F.col("duration_ms"))).alias("min_ms"), F.max(F.when(ok, F.col("duration_ms"))).alias("max_ms"),
    )


def batch_summary(manifest: DataFrame) -> DataFrame:
    """Successes, share and means over a batch manifest (success, elapsed_ms, quality)."""
    ok = F.col("success")
    return manifest.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), (F.count_if(ok) * 100.0 / F.count("*")).alias("percent"), F.avg(F.when(ok, F.col("elapsed_ms"))).alias("avg_ms"), F.avg(F.when(ok, F.col("quality"))).alias("avg_quality")
    )


def request_spans(events: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Each start with the next end of the same key, if any (key, start_id, start_ts, end_id, end_ts).

    Starts and ends are dealt over ranges of (key, time); the first end of the ranges behind is carried into each, so a
    key with any share of all events is many tasks' work.
    """
    order = [key, "ts", "event_id"]
    marked = events.filter(start | end).select(*order, start.alias("start_"), F.when(end, F.struct("ts", "event_id")).alias("end_"))
    ranged = carried(in_ranges(marked, order, "spans"), [key], {"later_": (F.min("end_"), F.min)}, behind=True)
    after = inside([key], [F.desc("ts"), F.desc("event_id")]).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("next_", F.coalesce(F.last("end_", ignorenulls=True).over(after), F.col("later_"))).filter("start_")
    return found.select(key, F.col("event_id").alias("start_id"), F.col("ts").alias("start_ts"), F.col("next_.event_id").alias("end_id"), F.col("next_.ts").alias("end_ts"))


def spans_by_id(logs: DataFrame) -> DataFrame:
    """Request spans of a log by request_id, from messages that begin with ``Request started``, ``completed`` or ``error``."""
    kind = F.regexp_extract("message", r"^Request (started|completed|error)", 1)
    at = lambda k: F.min(F.when(kind.isin(*k), F.col("timestamp")))
    return logs.filter(kind != "").groupBy("request_id").agg(at(["started"]).alias("start_ts"), at(["completed", "error"]).alias("end_ts"), (F.count_if(kind == "error") > 0).alias("failed")).filter("start_ts is not null")


def parse_request(message: Column) -> Column:
    """struct<method,path,status> of a log message; what is absent is null."""
    found = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit(""))
    return F.struct(found(r"\b(GET|POST|PUT|DELETE|PATCH|HEAD)\b").alias("method"), found(r"(/[^ ?]*)").alias("path"), found(r"\b([1-5][0-9][0-9])\b").cast("int").alias("status"))


def scalability(runs: DataFrame) -> DataFrame:
    """Mean throughput and correlation of size with time; linear over 0.95."""
    return runs.agg(F.avg(F.col("size") / F.col("elapsed")).alias("throughput"), F.corr("size", "elapsed").alias("correlation")).withColumn("linear", F.col("correlation") > 0.95)


def method_efficiency(runs: DataFrame) -> DataFrame:
    """Mean time of each method, its ratio to the fastest and its place; the window runs over methods."""
    mean = runs.groupBy("method").agg(F.avg("elapsed").alias("avg_elapsed"))
    whole = Window.partitionBy()
    return mean.withColumns({"ratio": F.col("avg_elapsed") / F.min("avg_elapsed").over(whole), "place": F.row_number().over(whole.orderBy("avg_elapsed", "method"))})


def tradeoff(runs: DataFrame) -> DataFrame:
    """The configuration with the best quality per time, quality being 100 less the mean difference."""
    scored = runs.groupBy("config").agg((100 - F.avg("delta_e")).alias("quality"), F.avg("elapsed").alias("avg_elapsed")).withColumn("score", F.col("quality") / F.col("avg_elapsed"))
    best = scored.agg(F.max_by("config", F.struct("score", "config")).alias("best"))
    return scored.join(F.broadcast(best)).withColumn("is_best", F.col("config") == F.col("best")).drop("best")


def evaluate_checks(df: DataFrame, expectations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(check, severity, failed) of registered expectations (name, SQL predicate, severity): one pass for all of them."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"c{i}") for i, (_, p, _) in enumerate(expectations)])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("failed")) for i, (n, _, s) in enumerate(expectations)])
    return counts.select(F.inline(rows))
