"""Queries of telemetry and streaming over ``events`` and ``lineitem``, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import telemetry as tm
from tessera.plans.pixel_tables import rounded
from tessera.sources.folders import shared_folder
from tessera.streaming import jobs

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


METRIC_SQL = """metric AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS operation, value AS duration_ms, concat('algo_', CAST(user_id % 5 AS VARCHAR)) AS algorithm_id,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory_mb, event_type NOT IN ('error', 'signup', 'view') OR user_id % 5 = 0 AS success, user_id, CAST((user_id * 7) % 100 AS DOUBLE) AS cpu_percent FROM events)"""


def metrics(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), F.concat(F.lit("algo_"), (F.col("user_id") % 5).cast("string")).alias("algorithm_id"),
        F.get_json_object("props", "$.k").cast("double").alias("memory_mb"), (~F.col("event_type").isin("error", "signup", "view") | (F.col("user_id") % 5 == 0)).alias("success"), "user_id",
        ((F.col("user_id") * 7) % 100).cast("double").alias("cpu_percent"),
    )


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark.read.parquet(f"{d}/events.parquet"))


_OP = "count(*) AS calls, round(sum(duration_ms), 4) AS total_ms, round(avg(duration_ms), 4) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(memory_mb), 4) AS avg_memory_mb, round(avg(cpu_percent), 4) AS avg_cpu_percent, max(ts) AS last_call, count(*) FILTER (NOT success) AS errors"


@query(f"WITH {METRIC_SQL} SELECT operation, {_OP.replace('max(ts)', 'CAST(epoch_us(max(ts)) AS BIGINT)')} FROM metric GROUP BY operation")
def operation_stats(spark: SparkSession, d: str) -> DataFrame:
    out = tm.operation_statistics(_metrics(spark, d)).withColumn("last_call", F.unix_micros("last_call"))
    return rounded(out, "total_ms", "avg_ms", "avg_memory_mb", "avg_cpu_percent", digits=4)


_HEALTH = "SELECT algorithm_id, count(*) AS calls, count(*) FILTER (NOT success) AS errors, avg(success::INT) AS rate FROM metric GROUP BY algorithm_id"


@query(f"WITH {METRIC_SQL} SELECT algorithm_id, calls, errors, round(rate, 4) AS success_rate, CASE WHEN rate < 0.5 THEN 'critical' WHEN rate < 0.8 THEN 'warning' ELSE 'healthy' END AS status FROM ({_HEALTH})")
def algorithm_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.algorithm_health(_metrics(spark, d)), "success_rate", digits=4)


_CHECKS = "checks AS (SELECT event_id, ts, event_type AS chk, CASE WHEN value > 40 THEN 'critical' WHEN value > 10 THEN 'warning' ELSE 'healthy' END AS status FROM events)"


@query(
    f"""WITH {_CHECKS}, now AS (SELECT * FROM checks QUALIFY row_number() OVER (PARTITION BY chk ORDER BY ts DESC, event_id DESC) = 1)
SELECT count(*) FILTER (status = 'healthy') AS n_healthy, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'critical') AS n_critical,
 CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS worst,
 coalesce(string_agg(chk, ',' ORDER BY chk) FILTER (status = 'warning'), '') AS warnings, coalesce(string_agg(chk, ',' ORDER BY chk) FILTER (status = 'critical'), '') AS criticals FROM now"""
)
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    checks = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.col("event_type").alias("check"), F.when(v > 40, "critical").when(v > 10, "warning").otherwise("healthy").alias("status"))
    return tm.health_rollup(checks)


@query(f"WITH {METRIC_SQL}, recent AS (SELECT * FROM metric ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT (SELECT round(avg(duration_ms), 4) FROM recent) AS recent_avg_ms, (SELECT round(avg(memory_mb), 4) FROM recent) AS recent_avg_memory_mb, (SELECT count(*) FROM recent) AS n_recent, count(DISTINCT operation) AS operations, count(*) AS calls FROM metric")
def dashboard_last50(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.dashboard(_metrics(spark, d)), "recent_avg_ms", "recent_avg_memory_mb", digits=4)


@query(f"WITH {METRIC_SQL} SELECT algorithm_id, event_id, CAST(row_number() OVER (PARTITION BY algorithm_id ORDER BY ts DESC, event_id DESC) AS INT) AS nth FROM metric WHERE NOT success QUALIFY nth <= 10")
def last_errors(spark: SparkSession, d: str) -> DataFrame:
    return tm.latest_per(_metrics(spark, d).filter(~F.col("success")), ["algorithm_id"], 10).select("algorithm_id", "event_id", "nth")


@query(
    """WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT s.user_id, s.event_id AS start_id, min(struct_pack(ts := e.ts, id := e.event_id)) AS nxt FROM s LEFT JOIN e ON e.user_id = s.user_id AND (e.ts, e.event_id) > (s.ts, s.event_id) GROUP BY ALL)
SELECT user_id, start_id, nxt.id AS end_id FROM m"""
)
def request_spans(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return tm.request_spans(events, "user_id", F.col("event_type") == "click", F.col("event_type") == "purchase").select("user_id", "start_id", "end_id")


@query(f"WITH {METRIC_SQL} SELECT count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(avg(success::INT), 4) AS success_rate, round(avg(duration_ms) FILTER (success), 4) AS avg_ms, min(duration_ms) FILTER (success) AS min_ms, max(duration_ms) FILTER (success) AS max_ms FROM metric")
def request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.request_metrics(_metrics(spark, d)), "success_rate", "avg_ms", digits=4)


@query(f"WITH {METRIC_SQL} SELECT count(*) AS total, count(*) FILTER (success) AS ok, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS percent, round(avg(duration_ms) FILTER (success), 4) AS avg_ms, round(avg(memory_mb) FILTER (success), 4) AS avg_quality FROM metric")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    manifest = _metrics(spark, d).select("success", F.col("duration_ms").alias("elapsed_ms"), F.col("memory_mb").alias("quality"))
    return rounded(tm.batch_summary(manifest), "percent", "avg_ms", "avg_quality", digits=4)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_returnflag").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("config"), F.col("l_quantity").cast("double").alias("elapsed"), F.col("l_extendedprice").alias("size"), (F.col("l_discount") * 100).alias("delta_e")
    )


@query("SELECT round(avg(l_extendedprice / l_quantity), 4) AS throughput, round(corr(l_extendedprice, l_quantity), 4) AS correlation, corr(l_extendedprice, l_quantity) > 0.95 AS linear FROM lineitem")
def scalability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.scalability(_runs(spark, d)), "throughput", "correlation", digits=4)


@query("WITH m AS (SELECT l_returnflag AS method, avg(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT method, round(t, 4) AS avg_elapsed, round(t / min(t) OVER (), 4) AS ratio, CAST(row_number() OVER (ORDER BY t, method) AS INT) AS place FROM m")
def method_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.method_efficiency(_runs(spark, d)), "avg_elapsed", "ratio", digits=4)


@query("WITH m AS (SELECT concat(l_returnflag, l_linestatus) AS config, 100 - avg(l_discount * 100) AS q, avg(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT config, round(q, 4) AS quality, round(t, 4) AS avg_elapsed, round(q / t, 4) AS score, row_number() OVER (ORDER BY q / t DESC, config DESC) = 1 AS is_best FROM m")
def tradeoff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.tradeoff(_runs(spark, d)), "quality", "avg_elapsed", "score", digits=4)


@query("SELECT event_id, CASE WHEN value > 90 THEN 'critical' WHEN value > 75 THEN 'warning' ELSE 'healthy' END AS memory, CASE WHEN value * 2 > 95 OR 100 - value < 1 THEN 'critical' WHEN value * 2 > 85 OR 100 - value < 5 THEN 'warning' ELSE 'healthy' END AS disk, CASE WHEN value * 3 > 80 THEN 'warning' ELSE 'healthy' END AS cpu FROM events")
def resource_bands(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", tm.resource_bands(v, v * 2, 100 - v, v * 3).alias("b")).select("event_id", "b.*")


EXPECTATIONS = [("positive_value", "value >= 0", "critical"), ("known_type", "event_type IN ('click', 'view', 'purchase')", "warning"), ("has_props", "props IS NOT NULL", "warning")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{s}' AS severity, count(*) FILTER (NOT coalesce({p}, false)) AS failed FROM events" for n, p, s in EXPECTATIONS))
def registered_checks(spark: SparkSession, d: str) -> DataFrame:
    return tm.evaluate_checks(spark.read.parquet(f"{d}/events.parquet"), EXPECTATIONS)


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred: the limit is the feature."""
    return tm.latest(spark.read.parquet(f"{d}/events.parquet"), 100).select("event_id", "event_type", "value")


@query(f"WITH {METRIC_SQL} SELECT event_id, operation FROM metric WHERE operation IN ('click', 'error')")
def chosen_operations(spark: SparkSession, d: str) -> DataFrame:
    return tm.chosen(_metrics(spark, d), operations=("click", "error")).select("event_id", "operation")


# Log lines made of events: one for each, with a request in its message.
LOG_SQL = """logs AS (SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
 CASE user_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'sent' END || ' /users/' || user_id || '?page=' || event_id || ' ' || CASE event_type WHEN 'error' THEN '500' ELSE '200' END AS message FROM events)"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    message = F.concat(F.when(user % 3 == 0, "GET").when(user % 3 == 1, "POST").otherwise("sent"), F.lit(" /users/"), user.cast("string"), F.lit("?page="), F.col("event_id").cast("string"), F.lit(" "), F.when(kind == "error", "500").otherwise("200"))
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", stamp.alias("timestamp"), level.alias("level"), message.alias("message"))


@query(f"WITH {LOG_SQL} SELECT timestamp, level, message FROM logs WHERE level IN ('ERROR', 'WARNING') ORDER BY timestamp DESC, message DESC LIMIT 50")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty errors and warnings: the limit is the feature."""
    return tm.log_tail(_logs(spark, d).drop("event_id"), 50, ("ERROR", "WARNING"))


@query(f"WITH {LOG_SQL} SELECT event_id, nullif(regexp_extract(message, '\\b(GET|POST|PUT|DELETE|PATCH|HEAD)\\b', 1), '') AS method, nullif(regexp_extract(message, '(/[^ ?]*)', 1), '') AS path, CASE WHEN message LIKE '% 500' THEN 500 ELSE 200 END AS status FROM logs")
def parsed_requests(spark: SparkSession, d: str) -> DataFrame:
    bare = _logs(spark, d).withColumn("message", F.regexp_replace("message", r"\d+\?page=\d+", "all"))
    parsed = _logs(spark, d).select("event_id", tm.parse_request(F.col("message")).alias("r")).select("event_id", "r.method", "r.path")
    return parsed.join(bare.select("event_id", tm.parse_request(F.col("message"))["status"].alias("status")), "event_id")


@query(f"WITH {LOG_SQL} SELECT event_id, replace(replace(replace(timestamp, '-', ''), ':', ''), 'T', '_') AS stamp FROM logs")
def file_stamps(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).select("event_id", tx.file_stamp(tx.iso_timestamp(F.col("timestamp"))).alias("stamp"))


@query(
    """WITH logs AS (SELECT l_orderkey, strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d') AS timestamp, CASE WHEN l_linenumber = 1 THEN 'started' WHEN l_returnflag = 'R' THEN 'error' ELSE 'completed' END AS kind FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS request_id, min(timestamp) FILTER (kind = 'started') AS start_ts, min(timestamp) FILTER (kind <> 'started') AS end_ts, bool_or(kind = 'error') AS failed FROM logs GROUP BY l_orderkey HAVING min(timestamp) FILTER (kind = 'started') IS NOT NULL"""
)
def spans_by_request(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests: the first line starts one, returned lines are errors, others complete it."""
    kind = F.when(F.col("l_linenumber") == 1, "started").when(F.col("l_returnflag") == "R", "error").otherwise("completed")
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    logs = items.select(F.col("l_orderkey").cast("string").alias("request_id"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("timestamp"), F.concat(F.lit("Request "), kind).alias("message"))
    return tm.spans_by_id(logs)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A table is a folder of files or one file; the stream source takes a folder, and a glob for the one file in it.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parque[t]")


def _collected(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the rows of all micro-batches as a table."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # Under the number of the batch: one that runs again replaces its rows.
    jobs.run_available(df, f"{base}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={n}"), mode)
    return spark.read.schema(df.schema).parquet(f"{base}/rows").select(*df.columns)


@query(f"WITH {METRIC_SQL} SELECT CAST(epoch_us(date_trunc('minute', ts)) AS BIGINT) AS window_start, operation, count(*) AS calls, round(sum(duration_ms), 4) AS total_ms, count(*) FILTER (NOT success) AS errors FROM metric GROUP BY ALL")
def streamed_operation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a stream that has ended: all are complete, so the complete mode's last batch is the result."""
    stats = jobs.running_operation_statistics(metrics(_stream(spark, d)))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_available(stats, f"{base}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/rows"), "complete")
    out = spark.read.schema(stats.schema).parquet(f"{base}/rows")
    return rounded(out.select(F.unix_micros("window_start").alias("window_start"), "operation", "calls", "total_ms", "errors"), "total_ms", digits=4)


@query(f"WITH {METRIC_SQL} SELECT algorithm_id, calls, errors, CASE WHEN rate < 0.5 THEN 'critical' WHEN rate < 0.8 THEN 'warning' ELSE 'healthy' END AS status FROM ({_HEALTH})")
def streamed_algorithm_health(spark: SparkSession, d: str) -> DataFrame:
    """The last counts of each algorithm, whatever the number of micro-batches."""
    changes = _collected(spark, jobs.running_algorithm_health(metrics(_stream(spark, d)).select("algorithm_id", "success", "ts", "event_id")))
    return changes.groupBy("algorithm_id").agg(F.max(F.struct("calls", "errors", "status")).alias("last")).select("algorithm_id", "last.*")


@query("SELECT event_id, CASE WHEN value > 90 THEN 'critical' WHEN value > 75 THEN 'warning' ELSE 'healthy' END AS memory FROM events WHERE value > 75")
def streamed_alerts(spark: SparkSession, d: str) -> DataFrame:
    samples = _stream(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("memory_percent"), F.lit(0.0).alias("disk_percent"), F.lit(100.0).alias("disk_free_gb"), F.lit(0.0).alias("cpu_percent"))
    keyed = jobs.threshold_alerts(samples.withColumn("ts", F.col("event_id")))
    return _collected(spark, keyed).select(F.col("ts").alias("event_id"), "memory")


@query("SELECT CAST(s.user_id AS VARCHAR) AS request_id, s.event_id AS start_id, e.event_id AS end_id FROM events s JOIN events e ON e.user_id = s.user_id AND s.event_type = 'click' AND e.event_type = 'purchase' AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR")
def streamed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of a stream with the purchases of the same user within an hour: a join of two streams with bounded state."""
    events = _stream(spark, d).select(F.col("user_id").cast("string").alias("request_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    starts, ends = events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'")
    spans = jobs.request_spans(starts, ends, keep=["event_id"]).filter("end_event_id IS NOT NULL")
    return _collected(spark, spans.select("request_id", "event_id", "end_event_id")).select("request_id", F.col("event_id").alias("start_id"), F.col("end_event_id").alias("end_id"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, first_value(CASE WHEN event_type = 'purchase' THEN {'id': event_id, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events WHERE event_type IN ('click', 'purchase'))
SELECT CAST(user_id AS VARCHAR) AS request_id, event_id AS start_id, nxt.id AS end_id FROM e WHERE event_type = 'click' AND nxt.ts <= ts + INTERVAL 1 HOUR""")
def streamed_next_spans(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of a stream with the next purchase of the same user, if within an hour, by state and timers of each user."""
    events = _stream(spark, d).filter("event_type IN ('click', 'purchase')")
    events = events.select(F.col("user_id").cast("string").alias("request_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "click").alias("starts"))
    return _collected(spark, jobs.next_end_spans(events)).filter("end_id IS NOT NULL").select("request_id", "start_id", "end_id")
