import datetime as dt
import random

from pyspark.sql import functions as F
from test_sources import png

from tessera.operators import corpus, telemetry, transfer
from tessera.streaming import jobs


def test_log_spans_and_message_parts(spark):
    rows = [("r1", "t1", "Request started: GET /api/x?q=1"), ("r1", "t3", "Request completed: GET /api/x 200"), ("r2", "t2", "Request started: POST /y"), ("r3", "t4", "Request started: GET /z"), ("r3", "t5", "Request error 500"), (None, "t6", "other")]
    logs = spark.createDataFrame(rows, "request_id string, timestamp string, message string")
    assert {r.request_id: (r.start_ts, r.end_ts, r.failed) for r in telemetry.spans_by_id(logs).collect()} == {"r1": ("t1", "t3", False), "r2": ("t2", None, False), "r3": ("t4", "t5", True)}
    parts = [tuple(r.p) for r in logs.select(telemetry.parse_request(F.col("message")).alias("p")).collect()]
    assert parts[0] == ("GET", "/api/x", None) and parts[1] == ("GET", "/api/x", 200) and parts[5] == (None, None, None)


def test_stream_join_against_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    starts = spark.createDataFrame([("a", at(0)), ("b", at(1)), ("c", at(2)), ("z", at(900))], "request_id string, ts timestamp")
    ends = spark.createDataFrame([("a", at(5)), ("c", at(300)), ("z", at(901))], "request_id string, ts timestamp")
    starts.coalesce(1).write.parquet(f"{tmp_path}/s")
    ends.coalesce(1).write.parquet(f"{tmp_path}/e")
    batch = {(r.request_id, r.end_ts) for r in jobs.request_spans(starts, ends).collect()}
    assert batch == {("a", at(5)), ("b", None), ("c", None), ("z", at(901))}
    stream = jobs.request_spans(spark.readStream.schema(starts.schema).parquet(f"{tmp_path}/s"), spark.readStream.schema(ends.schema).parquet(f"{tmp_path}/e"))
    got = []
    jobs.run_available(stream, f"{tmp_path}/c", lambda b, _: got.extend((r.request_id, r.end_ts) for r in b.collect()))
    assert set(got) <= batch and ("a", at(5)) in got and len(got) == len(set(got))


def test_new_images_are_transferred_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    reference = spark.createDataFrame([("r", 0, 0, 50.0, 1.0, 2.0), ("r", 1, 0, 60.0, 3.0, 9.0)], "image_id string, x int, y int, L double, a double, b double")
    run = lambda: jobs.incremental_transfer(spark, str(folder), reference, str(tmp_path / "out"), str(tmp_path / "c"))
    png(folder / "one.png", 2, 1, [(255, 0, 0), (0, 0, 255)], 3)
    (folder / "bad.png").write_bytes(b"nothing")
    run()
    png(folder / "two.png", 2, 1, [(9, 9, 9), (80, 80, 80)], 3)
    run()
    manifest = sorted((r.image_id, r.success) for r in spark.read.parquet(f"{tmp_path}/out/manifest").collect())
    assert manifest == [("bad.png", False), ("one.png", True), ("two.png", True)]
    assert spark.read.parquet(f"{tmp_path}/out/pixels").groupBy("image_id").count().filter("count = 2").count() == 2
    # A batch whose end was not recorded runs again and changes nothing.
    before = sorted(map(str, jobs.committed_pixels(spark, f"{tmp_path}/out").collect()))
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    run()
    assert sorted(map(str, jobs.committed_pixels(spark, f"{tmp_path}/out").collect())) == before and len(before) == 4
    assert spark.read.parquet(f"{tmp_path}/out/manifest").count() == 3


def test_spans_by_state_and_timers(spark, tmp_path):
    """Over several micro-batches as in one table; a start whose time is over comes alone, and its key has no state any more."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rng = random.Random(2)
    rows = [(rng.choice("abc"), 4 * m + i, at(m), rng.random() < 0.6) for m in range(0, 900, 7) for i in range(2)] + [("idle", 5000, at(100), True), ("last", 6000, at(3000), False)]
    schema = "request_id string, event_id long, ts timestamp, starts boolean"
    for part in range(4):
        mine = [r for r in rows if part == min(3, int((r[2] - at(0)).total_seconds() // 18_000))]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = []
    try:
        jobs.run_available(jobs.next_end_spans(stream), f"{tmp_path}/c", lambda b, _: got.extend(b.collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = telemetry.request_spans(spark.createDataFrame(rows, schema), "request_id", F.col("starts"), ~F.col("starts"))
    near = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) <= 3_600_000_000
    want = {r.start_id: r.end_id for r in batch.select("start_id", F.when(near, F.col("end_id")).alias("end_id")).collect()}
    assert {r.start_id: r.end_id for r in got} == want and len(got) == len(want) and want[5000] is None


def test_spans_of_a_hot_key(spark):
    """A user with most events is cut into ranges; the next end is found across them, and null users are a user."""
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 7, None, 9]), i, rng.randint(0, 900), rng.choice(["click", "click", "purchase", "view"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts int, kind string").repartition(4)
    got = {r.start_id: r.end_id for r in telemetry.request_spans(df, "user_id", F.col("kind") == "click", F.col("kind") == "purchase").collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    want = {}
    for i, r in enumerate(ordered):
        if r[3] == "click":
            want[r[1]] = next((o[1] for o in ordered[i + 1 :] if o[0] == r[0] and o[3] == "purchase"), None)
    assert got == want


def test_running_health_changes_status(spark, tmp_path):
    rows = [("a", i < 3, dt.datetime(2024, 1, 1, 0, i), i) for i in range(20)]
    spark.createDataFrame(rows, "algorithm_id string, success boolean, ts timestamp, event_id long").coalesce(1).write.parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema("algorithm_id string, success boolean, ts timestamp, event_id long").parquet(f"{tmp_path}/m")
    got = []
    jobs.run_available(jobs.running_algorithm_health(stream), f"{tmp_path}/c", lambda b, _: got.extend(b.collect()))
    assert got[-1].status == "critical" and got[-1].errors == 17 and list(got[-1].last_errors) == list(range(10, 20))


def test_running_health_over_several_micro_batches(spark, tmp_path):
    """The last row of an algorithm has the counts of all micro-batches, also where its status did not change."""
    for i in range(4):
        rows = [("a", True, dt.datetime(2024, 1, 1, i, 0), 2 * i), ("a", i != 3, dt.datetime(2024, 1, 1, i, 1), 2 * i + 1), ("b", True, dt.datetime(2024, 1, 1, i, 2), 100 + i)]
        spark.createDataFrame(rows, "algorithm_id string, success boolean, ts timestamp, event_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema("algorithm_id string, success boolean, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
    got = []
    jobs.run_available(jobs.running_algorithm_health(stream), f"{tmp_path}/c", lambda b, _: got.extend(b.collect()))
    last = {r.algorithm_id: (r.calls, r.errors, r.status) for r in sorted(got, key=lambda r: r.calls)}
    assert last == {"a": (8, 1, "healthy"), "b": (4, 0, "healthy")} and sum(r.changed for r in got) == 2


def test_breakdown_and_config(spark):
    found = spark.createDataFrame([("text",), ("text",), ("symbol",)], "source string")
    assert {r.source: r.n for r in corpus.search_breakdown(found).collect()} == {"text": 2, "symbol": 1}
    assert transfer.validate_config({"weight": 0.5, "tile": 8, "overlap": 2}) == []
    assert len(transfer.validate_config({"weight": 2, "weights": {"q": 0.5}, "tile": 0, "overlap": 1, "steps": [{}]})) == 5


def test_a_key_of_a_stream_waits_with_one_timer():
    """However many starts a key has: closed ones need no timer, the others wait for the first of them."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.timers, self.rows = [], []

        def getListState(self, name, schema):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, spans = Handle(), jobs.OpenRequests(1_000_000)
    spans.init(handle)
    rows = [(i, i * 1000, True) for i in range(2000)] + [(5000, 2_000_000, False), (5001, 2_500_000, True), (5002, 2_600_000, True)]
    frame = pd.DataFrame(rows, columns=["event_id", "ts_us", "starts"])
    out = pd.concat(spans.handleInputRows(("k",), iter([frame]), Now(0)))
    assert sorted(out["start_id"].tolist()) == list(range(1000, 2000)) and set(out["end_id"]) == {5000}
    assert handle.timers == [1001] and len(handle.rows) == 1002
    over = pd.concat(spans.handleExpiredTimer(("k",), Now(2000), Now(1001)))
    assert sorted(over["start_id"].tolist()) == list(range(1000)) and over["end_id"].isna().all()
    assert handle.timers == [1001, 3501] and sorted(handle.rows) == [(5001, 2_500_000), (5002, 2_600_000)]
    earlier = pd.DataFrame([(6000, 2_550_000, False)], columns=["event_id", "ts_us", "starts"])
    out = pd.concat(spans.handleInputRows(("k",), iter([earlier]), Now(2000)))
    assert out["start_id"].tolist() == [5001] and handle.rows == [(5002, 2_600_000)]
