from pyspark.sql import functions as F

from tablewright.operators.logs import algorithm_status, job_progress, running_algorithm
from tablewright.operators.monitoring import alert_rows, hourly_windows
from tablewright.streaming import logs, monitoring, snapshots

FIRST = ["2024-05-01 10:00:00,000 - INFO - Training LogisticRegression...", "2024-05-01 10:00:01,500 - INFO - Training ensemble...",
         "2024-05-01 10:00:02,000 - INFO - ✅ LogisticRegression: Train=0.80", "", "2024-05-01 10:00:03,000 - INFO - Training KMeans..."]
SECOND = ["2024-05-01 10:00:04,000 - INFO - ❌ KMeans failed", "2024-05-01 10:00:05,000 - INFO - Training SVC...", "Model 1: SVC"]


def _run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_tail_and_status_over_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    seen = []
    for i, part in enumerate((FIRST, SECOND)):
        (source / f"job7.{i}.log").write_text("\n".join(part), encoding="utf-8")
        lines = logs.stream_log_lines(spark, str(source)).withColumn("job", F.lit("job7"))
        _run(logs.tail_lines(lines, f"{out}/tail", f"{out}/tail_checkpoint"))
        _run(logs.keep_status(lines, f"{out}/status", f"{out}/status_checkpoint"))
        row = job_progress(logs.read_status(spark, f"{out}/status")).first()
        seen.append((row.currently_running, row.completed, row.failed, row.total, row.progress_percent))
    assert seen[0] == ("KMeans", ["LogisticRegression"], [], 2, 50.0)
    assert seen[1] == ("SVC", ["LogisticRegression"], ["KMeans"], 3, 33.3)
    tail = {r.line: r.algorithm for r in spark.read.parquet(f"{out}/tail").collect()}
    assert len(tail) == 7 and tail["Model 1: SVC"] == "SVC" and tail[FIRST[1]] == "ensemble"


def test_batch_logs(spark):
    lines = spark.createDataFrame([("j", i, line) for i, line in enumerate(FIRST + SECOND)], "job string, position int, line string")
    status = algorithm_status(lines)
    assert running_algorithm(status).first().currently_running == "SVC"
    row = job_progress(status).first()
    assert (row.completed_count, row.failed_count, row.total, row.progress_percent) == (1, 1, 3, 33.3)


def _log(spark, rows):
    return spark.createDataFrame(rows, "id int, t string, probability double, failed boolean").select(
        "id", F.to_timestamp("t").alias("ts"), "probability", "failed")


def test_hourly_stream_late_rows_and_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = "2024-05-01 "
    first = [(i, f"{day}10:{i:02d}:00", 0.5, i % 4 == 0) for i in range(20)] + [(50, day + "12:30:00", 0.9, False)]
    _log(spark, first).write.parquet(f"{source}/a")
    like = spark.read.parquet(f"{source}/a")

    def stream():
        return spark.readStream.schema(like.schema).option("recursiveFileLookup", True).parquet(source)

    _run(monitoring.append_to(monitoring.hourly_stream(stream()), f"{out}/hours", f"{out}/c1"))
    _run(monitoring.alert_stream(stream(), f"{out}/alerts", f"{out}/c2"))
    # 10:05 is over an hour behind 12:30: dropped.  14:00 closes the hour of 12:30.
    _log(spark, [(60, day + "10:05:00", 0.5, False), (61, day + "14:00:00", 0.1, False)]).write.parquet(f"{source}/b")
    _run(monitoring.append_to(monitoring.hourly_stream(stream()), f"{out}/hours", f"{out}/c1"))
    got = {r.window_start.hour: r for r in spark.read.parquet(f"{out}/hours").collect()}
    want = {r.window_start.hour: r for r in hourly_windows(like).collect()}
    assert set(got) == {10, 12}
    for hour in got:
        assert tuple(got[hour]) == tuple(want[hour])
    assert {r.alert for r in monitoring.read_alerts(spark, f"{out}/alerts").collect()} == {
        r.alert for r in alert_rows(hourly_windows(like)).collect()} == {"error_rate", "borderline"}


def test_deduplication(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, name in enumerate("ab"):
        _log(spark, [(1, "2024-05-01 10:00:00", 0.5, False), (2 + i, "2024-05-01 10:01:00", 0.5, False)]).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema("id int, ts timestamp, probability double, failed boolean").option(
            "recursiveFileLookup", True).parquet(source)
        _run(monitoring.append_to(monitoring.deduplicated(stream), f"{out}/rows", f"{out}/c"))
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 2, 3]


def test_status_over_fifty_batches_and_a_restart(spark, tmp_path):
    """However many batches ran, few folders are left, and a reader opens one base and the deltas after it."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    names = ["LogisticRegression", "KMeans", "LinearSVC"]
    kept = logs.status_table(out, every=5)
    for half in (range(25), range(25, 50)):
        for i in half:
            stamp = f"2024-05-01 10:{i:02d}:00,000"
            text = [f"{stamp} - INFO - Training {names[i % 3]}...", f"{stamp} - INFO - ✅ {names[i % 3]}: Train=0.8" if i % 2 else "noise"]
            (source / f"part.{i}.log").write_text("\n".join(text), encoding="utf-8")
        lines = logs.stream_log_lines(spark, str(source), files_per_trigger=1).withColumn("job", F.lit("j"))
        _run(logs.keep_status(lines, out, f"{tmp_path}/checkpoint", every=5))
    there = kept.folders(spark)
    assert there["base"] == [44, 49] and len(there["delta"]) <= 10
    assert [p.rsplit("/", 2)[1:] for p in kept._live(spark)] == [["base", "epoch=49"]]
    got = {r.algorithm: (r.last_start.minute, r.first_completed.minute) for r in logs.read_status(spark, out).collect()}
    want = {n: (max(i for i in range(50) if names[i % 3] == n), min(i for i in range(50) if names[i % 3] == n and i % 2)) for n in names}
    assert got == want


def test_snapshots_of_repeated_and_broken_batches(spark, tmp_path):
    table = snapshots.SnapshotTable(str(tmp_path / "t"), "k int, v int", lambda d: d.groupBy("k").agg(F.max("v").alias("v")), every=3)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    assert table.read(spark).collect() == []
    for epoch in range(4):
        table.write(rows((epoch % 2, epoch)), epoch)
    state = lambda: {r.k: r.v for r in table.read(spark).collect()}
    assert state() == {0: 2, 1: 3} and table.folders(spark)["base"] == [2]
    table.write(rows((1, 3)), 3)  # repeated after a failure
    table.write(rows((0, 2)), 2)  # the epoch that was compacted, repeated
    assert state() == {0: 2, 1: 3}
    # A base that was not written to its end doesn't count.
    (tmp_path / "t/base/epoch=9").mkdir()
    assert state() == {0: 2, 1: 3} and table.folders(spark)["base"] == [2]
    for epoch in range(4, 12):
        table.write(rows((epoch % 2, epoch)), epoch)
    assert state() == {0: 10, 1: 11}
    assert table.folders(spark) == {"base": [8, 11], "delta": [9, 10, 11]}


def test_alerts_of_many_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for hour in range(8):
        rows = [(hour * 100 + i, f"2024-05-01 {hour:02d}:{i:02d}:00", 0.5, False) for i in range(12)]
        _log(spark, rows).coalesce(1).write.parquet(f"{source}/h{hour}")
    like = spark.read.parquet(f"{source}/h0")
    stream = spark.readStream.schema(like.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    _run(monitoring.alert_stream(stream, out, f"{tmp_path}/c", every=2))
    there = monitoring.alert_table(out).folders(spark)
    assert len(there["base"]) <= 2 and len(there["delta"]) <= 4
    assert sorted(r.window_start.hour for r in monitoring.read_alerts(spark, out).collect()) == list(range(6))
